"""Views over ``documents`` that hold what the raw table lacks: other scripts, bad bytes, blocks, JSON.

Each is a list of row-wise expressions that Spark and DuckDB read alike, so that
a query and its SQL start from the same rows. ``{G}`` stands for DuckDB's flag to
replace all matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_FIRST = "substring(split_part(text,chr(10),1),1,40)"
_TITLE = f"case when doc_id%4=0 then {_FIRST}||' '||source else {_FIRST} end"
_ID = "'poem-'||lpad(cast(doc_id+1 as string),7,'0')"
_BODY = "replace(text,chr(10),' ')"
_HEAD = f"{_TITLE}||chr(10)||lang"
_PLAIN = f"{_HEAD}||']'||chr(10)||source||chr(10)||{_BODY}"

_JSON_ID = f"case when doc_id%43=0 then 'poem-0000001' when doc_id%47=0 then 'bad-'||cast(doc_id as string) else {_ID} end"
_JSON_TEXT = "replace(replace(replace(text,chr(92),chr(92)||chr(92)),chr(34),chr(92)||chr(34)),chr(10),chr(92)||'n')"
_JSON_BLOCK = "case when doc_id%41=0 then chr(34)||cast(doc_id+1 as string)||chr(34) else cast(doc_id+1 as string) end"
_JSON = (
    f"'{{\"id\":\"'||{_JSON_ID}||'\",\"title\":\"t'||cast(doc_id as string)||'\",\"dynasty\":\"'||lang||'\",'"
    "||case when doc_id%37=0 then '' else '\"author\":\"'||source||'\",' end"
    f"||'\"text\":\"'||{_JSON_TEXT}||'\",\"source_block\":'||{_JSON_BLOCK}||'}}'"
)

# The characters that stand for a to z in verse.
_VERSE = "床前明月光疑是地上霜举头望低思故乡白日依山尽黄河入海"
_HAN = f"translate(lower(substring(regexp_replace(text,'[^A-Za-z]',''{{G}}),1,64)),'abcdefghijklmnopqrstuvwxyz','{_VERSE}')"


def _verse(clauses: int, width: int, marks: str = "，。", first: str | None = None) -> str:
    parts = [f"substring(han,{i * width + 1},{width})||'{marks[i % 2]}'" for i in range(clauses)]
    if first:
        parts[0] = f"{first}||'{marks[0]}'"
    return "||".join(parts)


_SPLIT = "case when doc_id%10=0 then 'test' when doc_id%10=1 then 'validation' else 'train' end"

VIEWS: dict[str, dict[str, str]] = {
    "v_records": {"id": _ID, "title": _TITLE, "dynasty": "lang", "author": "source", "text": "text", "source_block": "doc_id+1"},
    "v_raw": {
        "doc_id": "doc_id",
        "text": "case doc_id%7 when 0 then replace(text,chr(10),chr(13)||chr(10)) when 1 then replace(text,chr(10),chr(10)||chr(10)||chr(10)) when 2 then '  '||text||'　' "
        "when 3 then replace(text,'.','．') when 4 then '﻿'||text when 5 then replace(text,'e','é') else text end",
    },
    "v_blocks": {
        "block_number": "doc_id+1",
        "block": f"case when doc_id%11=0 then {_HEAD}||']'||chr(10)||{_BODY} when doc_id%13=0 then {_HEAD}||']'||chr(10)||' '||chr(10)||{_BODY} "
        f"when doc_id%17=0 then {_PLAIN}||chr(10)||{_TITLE}||chr(10)||lang||']'||chr(10)||source when doc_id%19=0 then {_HEAD}||chr(10)||source||chr(10)||{_BODY} "
        f"when doc_id%23=0 then ' '||chr(10)||lang||']'||chr(10)||source||chr(10)||{_BODY} else {_PLAIN} end",
    },
    "v_corpus": {
        "block_number": "doc_id+1",
        "kind": "case when doc_id%3=0 then 'classical' else 'latin' end",
        "block": "",
    },
    "v_formed": {"id": _ID, "title": _TITLE, "dynasty": "lang", "author": "source", "text": "text", "form": "case doc_id%5 when 0 then '五言绝句' when 1 then '七言律诗' when 2 then '' end"},
    "v_spaced": {"text": "case when doc_id%3=0 then replace(text,' the ',chr(10)||chr(10)) when doc_id%7=0 then replace(text,chr(10),chr(10)||chr(10)||' ') else text end"},
    "v_jsonl": {
        "line_number": "doc_id+1",
        "value": f"case when doc_id%29=0 then substring({_JSON},1,cast(floor(length({_JSON})/2.0) as int)) when doc_id%31=0 then '[\"x\"]' else {_JSON} end",
    },
    "v_dirty": {
        "id": _ID,
        "title": _TITLE,
        "dynasty": "lang",
        "author": "source",
        "source_block": "doc_id+1",
        "text": "case doc_id%10 when 0 then text||' <b>x</b>' when 1 then text||' https://a.example' when 2 then text||'注释' when 3 then text||'□' when 4 then text||'�' "
        "when 5 then text||chr(1) when 6 then text||'出自《诗经》' when 7 then text||' license license' else text end",
    },
    "v_latin_mix": {"id": _ID, "title": "'题'||cast(doc_id%3 as string)", "dynasty": "case when doc_id%5=0 then '' when doc_id%5=1 then '现代' else '唐朝' end", "author": "'佚名'", "text": "repeat('床，', cast(doc_id%100 as int))||text", "source_block": "doc_id+1"},
    "v_poems": {
        "id": _ID,
        "title": "'诗'||cast(doc_id as string)",
        "dynasty": "'唐朝'",
        "author": "source",
        "split": _SPLIT,
        "wanted": "case doc_id%4 when 0 then '五言绝句' when 1 then '七言绝句' when 2 then '五言律诗' else '七言律诗' end",
        "text": f"case doc_id%8 when 0 then {_verse(4, 5)} when 1 then {_verse(4, 7)} when 2 then {_verse(8, 5)} when 3 then {_verse(8, 7)} when 4 then {_verse(4, 5, '。。')} "
        f"when 5 then {_verse(4, 5)}||chr(10) when 6 then {_verse(4, 5, first='substring(han,1,6)')} else {_verse(4, 5, first='chr(97)||substring(han,2,4)')} end",
    },
    "v_requests": {
        "form": "case when doc_id%9=0 then '自由诗' else '五言绝句' end",
        "dynasty": "case when doc_id%7=0 then '' else lang end",
        "author": "case when doc_id%8=0 then repeat(source,9) else source end",
        "title": f"case when doc_id%6=0 then 'Ж'||{_FIRST} else {_FIRST} end",
        "samples": "doc_id%7",
        "temperature": "cast(doc_id%5 as double)/2",
        "top_k": "doc_id%211",
        "repetition_penalty": "0.9+cast(doc_id%4 as double)/2",
        "seed": "case when doc_id%5=0 then null else doc_id-2 end",
        "request": "doc_id",
    },
}


VIEWS["v_corpus"]["block"] = f"case when doc_id%3=0 then '诗'||chr(10)||'唐朝]'||chr(10)||'佚名'||chr(10)||({VIEWS['v_poems']['text']}) else ({VIEWS['v_blocks']['block']}) end"

#: What the columns of a view use often and is computed first.
FIRST = {"v_poems": {"han": _HAN}, "v_corpus": {"han": _HAN}}


def view(documents: DataFrame, name: str) -> DataFrame:
    first = {c: F.expr(e.replace("{G}", "")) for c, e in FIRST.get(name, {}).items()}
    documents = T.bind(documents, **first) if first else documents
    return documents.selectExpr(*(f"{e.replace('{G}', '')} as {c}" for c, e in VIEWS[name].items()))


def view_sql(name: str) -> str:
    """The view as a common table expression for DuckDB."""
    columns = ", ".join(f"{e.replace('{G}', chr(44) + chr(39) + 'g' + chr(39))} as {c}" for c, e in VIEWS[name].items())
    first = "".join(f", {e.replace('{G}', chr(44) + chr(39) + 'g' + chr(39))} as {c}" for c, e in FIRST.get(name, {}).items())
    return f"{name} as (select {columns} from (select *{first} from documents))"
