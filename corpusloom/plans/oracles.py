"""DuckDB SQL with the same rows and columns as the queries."""

from __future__ import annotations

from corpusloom.functions import unicode_classes as U
from corpusloom.functions.text import quoted
from corpusloom.operators.forms import form_pattern
from corpusloom.operators.tokens import LIMITS, SPECIALS
from corpusloom.plans.queries import BLOCK, FILE_RECORDS, SAMPLE_SIZES, SAMPLES, SHARD_TOKENS, STRIDE
from corpusloom.plans.views import view_sql
from corpusloom.policy import CLASSICAL, LATIN_SCRIPT, Policy

SEED = 42


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def sub(column: str, pattern: str, to: str = "", every: bool = True) -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(to)}{', ' + q('g') if every else ''})"


def strip(x: str) -> str:
    return sub(sub(x, U.EDGE_START, every=False), U.EDGE_END, every=False)


def compact(x: str) -> str:
    return sub(x, U.WS)


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, {q(U.LINE_BREAK)})"
    return f"case when {parts}[-1] = '' then {parts}[1:len({parts}) - 1] else {parts} end"


def fields(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda z: {strip('z')}), lambda z: z <> '')"


def size(x: str) -> str:
    return f"cast(coalesce(len({x}), 0) as bigint)"


def total(x: str) -> str:
    return f"cast(coalesce(sum({x}), 0) as bigint)"


def found(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def times(x: str, literal: str) -> str:
    return f"cast((length({x}) - length(replace({x}, {q(literal)}, ''))) / {len(literal)} as bigint)"


def latin(x: str) -> str:
    return f"(length({x}) - length({sub(x, U.LATIN)}))"


def reasons(rules: list[tuple[str, str]]) -> str:
    """Names of the rules that hold, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"case when {rule} then {q(name)} end" for name, rule in rules) + ")"


def isin(x: str, values: tuple[str, ...]) -> str:
    return f"{x} in ({', '.join(map(q, values))})" if values else "false"


def with_(*tables: str) -> str:
    return "with " + ", ".join(tables) + " "


def characters(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda z: z <> '')"


R, B, D, J, L, P = (view_sql(n) for n in ("v_records", "v_blocks", "v_dirty", "v_jsonl", "v_latin_mix", "v_poems"))
FINGERPRINT = f"sha256({compact('title')} || chr(10) || {compact('text')})"
BODY = f"sha256({compact('text')})"
BLANK = lambda x: f"not {like(x, U.NOT_WS)}"


def content_rules(p: Policy) -> str:
    everything = "(title || dynasty || author || text)"
    rules = [
        ("empty_title", BLANK("title")), ("empty_body", BLANK("text")), ("empty_dynasty", BLANK("dynasty")),
        ("unknown_dynasty", f"{like('dynasty', U.NOT_WS)} and not {isin('dynasty', p.known)}"), ("empty_author", BLANK("author")),
        (f"body_shorter_than_{p.min_length}", f"length(text) < {p.min_length}"),
        *((f"body_longer_than_{n}", f"length(text) > {n}") for n in (p.note_length, p.review_length, p.max_length)),
        ("unicode_replacement_character", f"contains({everything}, chr(65533))"), ("unexpected_control_character", like(everything, U.CONTROL)),
        ("possible_html", like("text", p.html)), ("contains_url", like("text", f"(?i){p.url}")),
    ]
    if p.latin_rules:
        rules += [
            ("latin_heavy_body", f"length({compact('text')}) >= {p.latin_least} and {latin('text')} > {p.latin_share} * length({compact('text')})"),
            ("latin_heavy_prefix", f"{latin(f'substring(text, 1, {p.prefix_length})')} >= {p.prefix_latin}"),
        ]
    return reasons(rules + [(f"contains_marker:{m}", f"contains(text, {q(m)})") for m in p.validation_markers])


def hard_rules(p: Policy) -> list[tuple[str, str]]:
    everything = "(title || author || dynasty || text)"
    rules = [
        ("unknown_dynasty", "dynasty = ''"), ("non_ancient_dynasty", isin("dynasty", p.unfit)),
        ("unsupported_dynasty", f"dynasty <> '' and not {isin('dynasty', p.unfit)} and not {isin('dynasty', p.allowed)}"),
        (f"body_shorter_than_{p.min_length}", f"length(text) < {p.min_length}"), (f"body_longer_than_{p.max_length}", f"length(text) > {p.max_length}"),
        ("contains_url", like("text", f"(?i){p.url}")),
    ]
    if p.ascii_alnum:
        rules += [("contains_ascii_alphanumeric", like("text", p.ascii_alnum)), ("contains_ascii_alphanumeric_metadata", like("(title || author || dynasty)", p.ascii_alnum))]
    rules += [("contains_missing_character_placeholder", like(everything, p.placeholder)), ("contains_corruption_symbol", like(everything, p.corruption))]
    if p.latin_rules:
        heavy = f"(length({compact('text')}) >= {p.latin_least} and {latin('text')} > {p.latin_share} * length({compact('text')}))"
        rules += [("latin_heavy_body", heavy), ("latin_heavy_prefix", f"not {heavy} and {latin(f'substring(text, 1, {p.prefix_length})')} >= {p.prefix_latin}")]
    return rules


def shape(p: Policy, source: str) -> str:
    """A table ``shaped``: the source's columns, clauses, total, short, prose_like, prose_signal."""
    marks = "[" + "".join(quoted(c) for c in p.clause_marks) + "]"
    clauses = f"list_transform(list_filter(list_transform(string_split_regex(text, {q(marks)}), lambda z: {strip('z')}), lambda z: z <> ''), lambda z: length(z))"
    counted = f"select *, {size('cl')} clauses, cast(coalesce(list_sum(cl), 0) as bigint) total, {size(f'list_filter(cl, lambda z: z <= {p.short_clause})')} short from (select *, {clauses} cl from {source})"
    prose = f"length(text) >= {p.prose_least} and clauses >= {p.prose_clauses} and total > {p.prose_mean} * clauses and short < {p.prose_short_share} * clauses"
    signal = " or ".join(f"contains(text, {q(m)})" for m in p.prose_signals)
    return f"shaped as (select *, prose_like or {signal} prose_signal from (select *, {prose} prose_like from ({counted})))"


def review_rules(p: Policy) -> list[tuple[str, str]]:
    rules = [(f"body_longer_than_{p.review_length}", f"length(text) > {p.review_length} and length(text) <= {p.max_length}")]
    rules += [(f"contains_marker:{m}", f"contains(text, {q(m)})") for m in p.body_markers]
    rules.append(("contains_source_explanation", like("text", p.source_explanation)))
    rules += [(f"title_marker:{m}", f"contains(title, {q(m)})") for m in p.title_markers]
    rules += [("possible_html_or_character_placeholder", like("text", p.html)), ("underscore_joined_title_metadata", "contains(title, '_')"), ("contains_parenthetical_citation", like("text", p.citation))]
    if p.ascii_punctuation:
        rules.append(("contains_ascii_punctuation", like("text", p.ascii_punctuation)))
    suffix = "(?:" + "|".join(p.title_suffixes) + r")\n?\z"
    return rules + [("prose_like_clause_lengths", "prose_like"), ("prose_genre_title_with_prose_signals", f"{like('title', suffix)} and prose_signal")]


def routed(p: Policy, source: str) -> str:
    marked = f"select *, {reasons(hard_rules(p))} hard, {reasons(review_rules(p))} review from shaped"
    status = "case when hard <> '' then 'quarantine' when review <> '' then 'review' else 'clean' end"
    return f"{shape(p, source)}, routed as (select *, {status} status, concat_ws(',', nullif(hard, ''), nullif(review, '')) reasons from ({marked}))"


def splits(source: str = "v_records", train: float = 0.9, validation: float = 0.05) -> str:
    """Tables keyed, sizes and splits."""
    return (
        f"keyed as (select *, {BODY} body_fingerprint from {source}), "
        f"sizes as (select body_fingerprint, count(*) n, sha256('{SEED}:' || body_fingerprint) o from keyed group by 1), "
        "placed as (select body_fingerprint, sum(n) over (order by o, body_fingerprint rows between unbounded preceding and current row) - n before from sizes), "
        f"goal as (select cast(floor(count(*) * {train}) as bigint) t, cast(floor(count(*) * {validation}) as bigint) v from keyed), "
        "splits as (select k.*, case when before < t then 'train' when before < t + v then 'validation' else 'test' end split from keyed k join placed using (body_fingerprint) cross join goal)"
    )


def formatted(p: Policy, form: str) -> str:
    f, c, a, t, b = p.labels
    return f"case when coalesce({form}, '') <> '' then {q(f)} || {form} || chr(10) else '' end || {q(c)} || dynasty || chr(10) || {q(a)} || author || chr(10) || {q(t)} || title || chr(10) || {q(b)} || text"


def encoded() -> str:
    """Tables up to vocab and tokens (id, split, formatted, toks)."""
    special = ", ".join(f"({q(t)}, {i}, 0)" for i, t in enumerate(SPECIALS))
    return (
        splits() + ", "
        f"formatted as (select *, {formatted(LATIN_SCRIPT, q(''))} formatted from splits), "
        f"chars as (select token, count(*) n from (select unnest({characters('formatted')}) token from formatted where split = 'train') group by 1), "
        f"vocab as (select * from (values {special}) s(token, id, count) union all select token, row_number() over (order by token) + {len(SPECIALS) - 1}, n from chars), "
        "exploded as (select id, split, formatted, generate_subscripts(c, 1) pos, unnest(c) token from (select id, split, formatted, string_split(formatted, '') c from formatted)), "
        "tokens as (select e.id, e.split, list_concat(list_concat([1], list(coalesce(v.id, 3) order by e.pos)), [2]) toks, string_agg(case when v.id is null then '' else e.token end, '' order by e.pos) decoded from exploded e left join vocab v on e.token = v.token and v.id > 3 group by e.id, e.split)"
    )


def streams() -> str:
    return encoded() + f", placed_tokens as (select id, split, toks, len(toks) n, sum(len(toks)) over (partition by split order by sha256('{SEED}:' || id), id rows between unbounded preceding and current row) - len(toks) tok_start from tokens), streams as (select split, flatten(list(toks order by tok_start)) s, sum(n) n from placed_tokens group by split)"


def digest(x: str) -> str:
    return f"sha256(array_to_string({x}, ','))"


STATS_STEPS = (
    "lf as (select text raw, regexp_replace(text, '\\r\\n?', chr(10), 'g') lf from v_raw), "
    "composed as (select *, nfc_normalize(lf) c from lf), "
    f"mapped as (select *, replace(replace(translate(c, {q(''.join(CLASSICAL.punctuation))}, {q(''.join(CLASSICAL.punctuation.values()))}), chr(65279), ''), chr(0), '') m from composed), "
    f"split_lines as (select *, string_split(m, chr(10)) b, list_transform(string_split(m, chr(10)), lambda z: case when {BLANK('z')} then z else {strip('z')} end) a from mapped), "
    "joined as (select *, array_to_string(a, chr(10)) j from split_lines), "
    f"done as (select *, {strip('regexp_replace(j, chr(10) || chr(123) || chr(51) || chr(44) || chr(125), chr(10) || chr(10), chr(103))')} d from joined)"
)
RAW = view_sql("v_raw")


def normal_blocks(source: str = "v_blocks", keep: str = "block_number") -> str:
    """Tables parts (block_number, block) of normalised v_blocks."""
    steps = f"replace(replace(translate(nfc_normalize(regexp_replace(block, '\\r\\n?', chr(10), 'g')), {q(''.join(LATIN_SCRIPT.punctuation))}, {q(''.join(LATIN_SCRIPT.punctuation.values()))}), chr(65279), ''), chr(0), '')"
    stripped = f"array_to_string(list_transform(string_split({steps}, chr(10)), lambda z: case when {BLANK('z')} then z else {strip('z')} end), chr(10))"
    return f"parts as (select {keep}, block from (select {keep}, unnest(string_split_regex({strip(f'''regexp_replace({stripped}, '\\n{{3,}}', chr(10) || chr(10), 'g')''')}, '\\n{{2,}}')) block from {source}) where {like('block', U.NOT_WS)})"


def parsed(source: str) -> str:
    """A table parsed with status and fields."""
    return (
        f"cut as (select * exclude (block, block_number), block_number source_block, {lines('block')} raw from {source}), "
        f"cut2 as (select *, list_transform(raw, lambda z: {strip('z')}) l, len(raw) n from cut), "
        "fields as (select *, case when n = 4 then l[1] end title, case when n = 4 then l[2] end marked, case when n = 4 then l[3] end author, case when n = 4 then l[4] end text from cut2), "
        f"parsed as (select *, 'poem-' || lpad(cast(source_block as varchar), 7, '0') id, {strip(sub('marked', chr(92) + ']' + chr(92) + 'z', every=False))} dynasty, "
        "concat_ws(',', case when n <> 4 then 'physical_line_count_not_4' end, case when title = '' then 'empty_title' end, case when text = '' then 'empty_body' end) reason from fields)"
    )


def structure() -> str:
    names = ("id", "title", "dynasty", "author", "text", "source_block")
    kind = lambda n: f"case when o then json_type(value, '$.{n}') end k_{n}"
    ok = lambda n: "('UBIGINT','BIGINT','BOOLEAN')" if n == "source_block" else "('VARCHAR')"
    rules = [(f"missing_field:{n}", f"o and k_{n} is null") for n in names] + [(f"wrong_type:{n}", f"k_{n} is not null and k_{n} not in {ok(n)}") for n in names]
    values = ", ".join(f"case when reasons = '' then json_extract_string(value, '$.{n}') end {n}" if n != "source_block" else "case when reasons = '' then cast(json_extract_string(value, '$.source_block') as bigint) end source_block" for n in names)
    return (
        "valid as (select *, json_valid(value) j from v_jsonl), objects as (select *, case when j then json_type(value) = 'OBJECT' else false end o from valid), "
        f"kinds as (select *, {', '.join(map(kind, names))} from objects), "
        f"judged as (select *, case when not j then 'invalid_json' when not o then 'record_not_object' else {reasons(rules)} end reasons from kinds), "
        f"structure as (select line_number, reasons, case when not j then 'invalid_json' end error, case when reasons <> '' then substring(value, 1, 500) end raw_excerpt, {values} from judged), "
        "keyed as (select *, min(line_number) over (partition by id) fid, min(line_number) over (partition by source_block) fsb from structure), "
        f"flagged as (select *, {reasons([('duplicate_id', 'id is not null and line_number > fid'), ('invalid_id_format', 'id is not null and not ' + like('id', LATIN_SCRIPT.id_pattern)), ('duplicate_source_block', 'source_block is not null and line_number > fsb')])} key_reasons from keyed), "
        f"validated as (select line_number, reasons <> '' structural, case when reasons = '' then concat_ws(',', nullif(key_reasons, ''), nullif({content_rules(LATIN_SCRIPT)}, '')) else reasons end reasons, id, dynasty, text from flagged)"
    )


def broken() -> str:
    cols = "id, title, dynasty, author, text, source_block, body_fingerprint, split"
    return splits() + (
        f", broken as (select id, case when source_block % 70 = 0 then title || '!' else title end title, dynasty, author, text, source_block, body_fingerprint, split from splits where source_block % 90 <> 0 "
        f"union all select {cols.replace('split', q('test') + ' split')} from splits where source_block % 50 = 0)"
    )


def overlaps() -> str:
    pairs = (("train", "validation"), ("train", "test"), ("validation", "test"))
    rows = []
    for key in ("id", "body_fingerprint", "source_block"):
        for a, b in pairs:
            rows.append(f"select '{key}' as key, '{a}/{b}' pair, count(*) shared from (select {key} from broken where split = '{a}' intersect select {key} from broken where split = '{b}')")
    return with_(R, broken()) + " union all ".join(rows)


def label() -> str:
    whens = " ".join(f"when {like('text', form_pattern(n, w, CLASSICAL))} then {q(name)}" for n, w, name in CLASSICAL.forms)
    return f"labelled as (select *, case {whens} end form from v_poems)"


def audit_tables() -> str:
    return (
        "mixed as (select id, title, case when source_block % 3 = 0 then 'xx' else dynasty end dynasty, author, text, source_block from v_records), "
        f"printed as (select *, {FINGERPRINT} fingerprint from mixed), "
        "firsts as (select *, row_number() over (partition by fingerprint order by source_block) rn from printed), "
        f"audit as (select r.fingerprint, k.id kept_id, k.source_block kept_source_block, r.id removed_id, r.source_block removed_source_block, {reasons([('dynasty', 'r.dynasty <> k.dynasty'), ('author', 'r.author <> k.author')])} metadata_conflicts, r.title removed_title from firsts r join firsts k on r.fingerprint = k.fingerprint and k.rn = 1 where r.rn > 1)"
    )


def funnel(rows: list[tuple[str, str, str]]) -> str:
    return " union all ".join(f"select cast({i} as bigint) place, {q(n)} stage, (select count(*) from {a}) rows_in, (select count(*) from {b}) rows_out" for i, (n, a, b) in enumerate(rows))


def percentiles() -> str:
    at = lambda f: f"cast(l[cast(floor((n - 1) * {f}) as bigint) + 1] as bigint)"
    counts = [f"cast(len(list_filter(l, lambda z: z < 8)) as bigint) under_8", *(f"cast(len(list_filter(l, lambda z: z > {x})) as bigint) over_{x}" for x in (500, 1000, 5000))]
    return f"select n texts, cast(l[1] as bigint) shortest, round(m, 6) mean, {at(0.5)} p50, {at(0.9)} p90, {at(0.95)} p95, {at(0.99)} p99, cast(l[-1] as bigint) longest, {', '.join(counts)} from (select list_sort(list(length(text))) l, count(*) n, avg(length(text)) m from v_records)"


def stats() -> str:
    blocks = lambda c: f"len(list_filter(string_split({c}, chr(10) || chr(10)), lambda z: {like('z', U.NOT_WS)}))"
    values = {
        "crlf": found("raw", r"\r\n"), "bare_cr": f"{found('raw', chr(92) + 'r')} - {found('raw', chr(92) + 'r' + chr(92) + 'n')}", "nfc_changed": "cast(lf <> c as int)", "nfc_delta": "length(c) - length(lf)",
        "bom": found("c", r"\x{feff}"), "nul": found("c", r"\x00"), "blank_lines_kept": f"len(list_filter(b, lambda z: z <> '' and {BLANK('z')}))",
        "lines_trimmed": "len(list_filter(list_zip(b, a), lambda z: z[1] <> z[2]))", "characters_trimmed": "length(m) - length(j)",
        "extra_newlines": f"coalesce(list_sum(list_transform(regexp_extract_all(j, '\\n{{3,}}'), lambda z: length(z) - 2)), 0)",
        "characters_before": "length(raw)", "characters_after": "length(d)", "lines_before": f"len({lines('raw')})", "lines_after": f"len({lines('d')})", "blocks_before": blocks("raw"), "blocks_after": blocks("d"),
        **{f"replaced_{ord(c):04X}": times("c", c) for c in CLASSICAL.punctuation},
    }
    return with_(RAW, STATS_STEPS) + " union all ".join(f"select {q(k)} statistic, {total(v)} n from done" for k, v in values.items())


def windows_sql() -> str:
    """Windows tile the stream, so x and y are its stretches of BLOCK tokens, from 0 and from 1 on."""
    stretch = lambda first, name: f"select split, (pos - {first}) // {BLOCK} k, count(*) c, sha256(string_agg(cast(token as varchar), ',' order by pos)) {name} from flat where pos >= {first} group by 1, 2"
    assert STRIDE == BLOCK
    return with_(R, streams(), "flat as (select split, unnest(toks) token, cast(tok_start as bigint) + generate_subscripts(toks, 1) - 1 pos from placed_tokens)") + (
        f"select split, cast(k * {BLOCK} as bigint) start, x, y from ({stretch(0, 'x')}) join (select split, k, y from ({stretch(1, 'y')}) where c = {BLOCK}) using (split, k)"
    )


def samples_sql() -> str:
    start = f"cast(('0x' || substring(sha256('{SEED}:' || split || ':' || cast(sample as varchar)), 1, 15))::bigint % (n - {BLOCK} - 1) as bigint)"
    return with_(R, streams()) + (
        f"select sample, split, start, {digest(f's[start + 1 : start + {BLOCK}]')} x, {digest(f's[start + 2 : start + {BLOCK} + 1]')} y "
        f"from (select split, s, sample, {start} start from streams, range({SAMPLES}) r(sample) where n > {BLOCK} + 1)"
    )


def screen_sql() -> str:
    c = CLASSICAL
    prompt = f"{q(c.labels[0])} || form || chr(10) || {q(c.labels[1])} || dynasty || chr(10) || {q(c.labels[2])} || author || chr(10) || {q(c.labels[3])} || title || chr(10) || {q(c.labels[4])}"
    rules = [("invalid_form", f"not {isin('form', tuple(n for _, _, n in c.forms))}")]
    rules += [(f"invalid_{k}", f"not length({k}) between {a} and {b}") for k, (a, b) in LIMITS.items()]
    rules += [
        ("invalid_samples", "not samples between 1 and 5"), ("invalid_temperature", "not (temperature > 0 and temperature <= 2)"), ("invalid_top_k", "not top_k between 1 and 200"),
        ("invalid_repetition_penalty", "not repetition_penalty between 1 and 2"), ("invalid_seed", "seed is not null and not seed between 0 and 2147483647"), ("unsupported_characters", "bad > 0"),
    ]
    return with_(
        view_sql("v_requests"),
        f"known as (select list(distinct z) k from (select unnest(string_split(text, '')) z from documents union all select unnest(string_split({q('体裁五言绝句朝代作者题目正文：' + chr(10) + '自由诗')}, '')))),",
    ).rstrip(", ") + f" select request, prompt, {reasons(rules)} reasons, {reasons(rules)} = '' accepted from (select *, len(list_filter({characters('prompt')}, lambda z: not list_contains(k, z))) bad from (select *, {prompt} prompt from v_requests), known)"


def blocks_sql() -> str:
    blocks = "select unnest(string_split(text, chr(10) || chr(10))) b from v_spaced"
    return with_(view_sql("v_spaced")) + f"select sha256(b) block_sha256, count(*) n from ({blocks}) where {like('b', U.NOT_WS)} group by 1"


def shards_sql() -> str:
    """Ids as two bytes each, the low one first, of the records that start in each stretch of the stream."""
    shard = f"cast(floor(tok_start / {SHARD_TOKENS}) as bigint)"
    packed = "array_to_string(list_transform(ids, lambda t: printf('%02x%02x', t & 255, t >> 8)), '')"
    gathered = f"select split, {shard} shard, count(*) records, flatten(list(toks order by tok_start)) ids from placed_tokens group by 1, 2"
    return with_(R, streams()) + (
        f"select split, shard, records, cast(len(ids) as bigint) n_tokens, {size('list_filter(ids, lambda t: t = 3)')} unknown_tokens, cast(2 * len(ids) as bigint) bytes, sha256(unhex({packed})) sha256 from ({gathered})"
    )


def prepared_sql() -> str:
    """Both kinds of blocks parsed and deduplicated together, routed by the rules of their own, poems labelled."""
    fields = "id, title, dynasty, author, text, source_block, kind"
    classical = routed(CLASSICAL, "classical").replace("shaped", "shaped_classical").replace("routed as", "routed_classical as")
    whens = " ".join(f"when {like('text', form_pattern(n, w, CLASSICAL))} then {q(name)}" for n, w, name in CLASSICAL.forms)
    return with_(
        view_sql("v_corpus"), normal_blocks("v_corpus", "block_number, kind"), parsed("parts"), f"recs as (select {fields} from parsed where reason = '')",
        f"uniq as (select *, {FINGERPRINT} fingerprint from recs qualify row_number() over (partition by fingerprint order by source_block) = 1)",
        "latin as (select * from uniq where kind = 'latin')", "classical as (select * from uniq where kind = 'classical')", routed(LATIN_SCRIPT, "latin"), classical,
        f"ok as (select {fields} from routed where status = 'clean' union all select {fields} from routed_classical where status = 'clean')",
        f"named as (select *, case {whens} end form from ok where kind = 'classical')",
    ) + funnel([("parse", "parts", "recs"), ("dedup", "recs", "uniq"), ("route", "uniq", "ok"), ("split", "ok", "ok"), ("label", "ok", "named where form is not null")])


def verdict_sql() -> str:
    """Counts of the splits as made and of the broken ones."""
    rows = []
    for name, table in (("made", "splits"), ("broken", "broken")):
        shared = {k: " + ".join(f"(select count(*) from (select {k} from {table} where split = '{a}' intersect select {k} from {table} where split = '{b}'))" for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))) for k in ("id", "body_fingerprint", "source_block")}
        b = f"(select id, min(title || chr(1) || text) x from {table} group by 1)"
        counts = {f"shared_{k}": v for k, v in shared.items()} | {
            "missing": f"(select count(*) from s where id not in (select id from {table}))", "extra": f"(select count(*) from {b} where id not in (select id from s))",
            "changed": f"(select count(*) from s join {b} b using (id) where s.x <> b.x)", "repeated": f"(select coalesce(cast(sum(n - 1) as bigint), 0) from (select count(*) n from {table} group by split, id))",
        }
        columns = ", ".join(f"cast({v} as bigint) {k}" for k, v in counts.items())
        rows.append(f"select '{name}' splits, case when {' + '.join(counts)} = 0 then 'PASS' else 'FAIL' end verdict, * from (select {columns})")
    return with_(R, broken(), "s as (select id, title || chr(1) || text x from v_records)") + " union all ".join(rows)


def oracle_sql() -> dict[str, str]:
    labelled = with_(P, label())
    dirty_routes = with_(D, routed(LATIN_SCRIPT, "v_dirty"))
    return {
        "read_text_blocks": blocks_sql(),
        "read_mixed_blocks": blocks_sql(),
        "utf8_gate": with_(R) + "select id, source_block % 5 <> 0 is_utf8, case when source_block % 5 <> 0 then sha256(text) end text_sha256 from v_records",
        "read_records_jsonl": with_(R) + "select id, title, dynasty, author, text, source_block from v_records",
        "write_records_jsonl": with_(R) + "select sha256(cast(to_json({id: id, title: title, dynasty: dynasty, author: author, text: text, source_block: source_block}) as varchar)) line_sha256, count(*) n from v_records group by 1",
        "write_token_shards": shards_sql(),
        "load_vocab": with_(R, encoded()) + "select token, cast(id as bigint) id, cast(count as bigint) as count from vocab",
        "artifact_manifest": with_(R) + f"select cast(strlen(t) as bigint) bytes, sha256(t) sha256 from (select string_agg(text || chr(10), '' order by source_block) t from v_records group by floor(source_block / {FILE_RECORDS}))",
        "global_index": with_(R) + "select source_block, id, row_number() over (order by source_block) ordinal from v_records",
        "corpus_totals": with_(D, f"l as (select text, {lines('text')} ls from v_dirty)")
        + f"select {total('strlen(text)')} bytes, {total('length(text)')} as characters, {total('len(ls)')} lines, {total(f'len(list_filter(ls, lambda z: {like(chr(122), U.NOT_WS)}))')} nonempty_lines, {total(f'len(ls) - len(list_filter(ls, lambda z: {like(chr(122), U.NOT_WS)}))')} blank_lines, "
        f"{total(times('text', chr(0xFFFD)))} replacement_characters, {total(found('text', U.CONTROL))} control_characters, (select count(distinct z) from (select unnest({characters('text')}) z from v_dirty)) distinct_characters from l",
        "field_count_histogram": with_(B, f"c as (select {size(fields('block'))} f, {size(lines('block'))} l from v_blocks)")
        + "select 'fields' section, f as key, count(*) blocks from c group by f union all select 'lines', l, count(*) from c group by l union all select 'malformed', -1, count(*) from c where f <> 4",
        "length_stats": with_(R) + percentiles(),
        "category_counts": with_(L) + "select case when dynasty = '' then '<EMPTY>' else dynasty end category, count(*) n from v_latin_mix group by 1",
        "marker_counts": with_(D) + " union all ".join(f"select {q(m)} marker, {total(times('text', m))} n from v_dirty" for m in LATIN_SCRIPT.profile_markers + CLASSICAL.profile_markers),
        "longest_records": with_(R) + "select cast(length(text) as bigint) length, source_block as block, title from v_records order by 1 desc, 2 desc, 3 desc limit 20",
        "malformed_examples": with_(B, f"c as (select block_number, {fields('block')} f from v_blocks)") + "select block_number as block, cast(len(f) as bigint) fields, coalesce(substring(f[1], 1, 80), '') first_field from c where len(f) <> 4 order by 1 limit 20",
        "char_frequency": with_(D) + f"select z as character, count(*) n from (select unnest({characters('text')}) z from v_dirty) group by 1",
        "normalize_text": with_(RAW, STATS_STEPS.replace("select text raw,", "select doc_id, text raw,")) + "select doc_id, d as text from done",
        "normalization_stats": stats(),
        "parse_accepted": with_(B, parsed("v_blocks")) + "select id, title, dynasty, author, text, source_block from parsed where reason = ''",
        "parse_rejected": with_(B, parsed("v_blocks")) + "select source_block, reason, cast(n as bigint) physical_line_count, array_to_string(raw, ',') raw_lines from parsed where reason <> ''",
        "parse_summary": with_(B, parsed("v_blocks"))
        + f"select count(*) total, count(*) filter (reason = '') accepted, count(*) filter (reason <> '') rejected, {total('case when reason = chr(0)[1:0] then length(text) end').replace('chr(0)[1:0]', chr(39) * 2)} body_characters, count(*) filter (reason = '' and dynasty = '') empty_category, count(*) filter (reason = '' and author = '') empty_author, count(*) filter (reason = '' and not ends_with(marked, ']')) category_without_bracket from parsed",
        "validate_structure": with_(J, structure()) + "select line_number, reasons, error, raw_excerpt from structure",
        "duplicate_key_flags": with_(J, structure()) + "select line_number, key_reasons from flagged",
        "content_reasons": with_(D) + f"select id, {content_rules(LATIN_SCRIPT)} reasons from v_dirty",
        "content_reasons_classical": with_(L) + f"select id, {content_rules(CLASSICAL)} reasons from v_latin_mix",
        "suspicious_records": with_(J, structure()) + "select line_number, reasons, id, dynasty from validated where reasons <> ''",
        "validation_summary": with_(J, structure())
        + "select count(*) lines, count(*) filter (not structural) valid_records, count(*) filter (reasons = 'invalid_json') json_errors, count(*) filter (structural and reasons <> 'invalid_json') schema_errors, "
        "count(*) filter (contains(reasons, 'duplicate_id')) duplicate_ids, count(*) filter (contains(reasons, 'duplicate_source_block')) duplicate_source_blocks, count(*) filter (reasons <> '') suspicious, cast(coalesce(min(length(text)) filter (not structural), 0) as bigint) shortest, cast(coalesce(max(length(text)) filter (not structural), 0) as bigint) longest from validated",
        "fingerprints": with_(R) + f"select id, {FINGERPRINT} fingerprint, {BODY} body_fingerprint from v_records",
        "dedup_keep_first": with_(R, f"p as (select *, {FINGERPRINT} fingerprint from v_records)") + "select id, title, dynasty, author, text, source_block, fingerprint from p qualify row_number() over (partition by fingerprint order by source_block) = 1",
        "duplicate_audit": with_(R, audit_tables()) + "select * from audit",
        "dedup_summary": with_(R, audit_tables(), "g as (select fingerprint, count(*) n from printed group by 1)")
        + f"select {total('n')} as input, count(*) retained, {total('n - 1')} removed, count(*) filter (n > 1) duplicate_groups, max(n) largest_group, (select count(*) from audit where contains(metadata_conflicts, 'dynasty')) dynasty_conflicts, (select count(*) from audit where contains(metadata_conflicts, 'author')) author_conflicts from g",
        "same_body_different_title": with_(R) + f"select {BODY} body_fingerprint, count(distinct {compact('title')}) titles, count(*) records from v_records group by 1 having count(distinct {compact('title')}) > 1",
        "clean_hard_reasons": with_(L) + f"select id, {reasons(hard_rules(CLASSICAL))} reasons from v_latin_mix",
        "clean_review_reasons": with_(D, shape(CLASSICAL, "v_dirty")) + f"select id, {reasons(review_rules(CLASSICAL))} reasons from shaped",
        "clause_shape": with_(R, shape(LATIN_SCRIPT, "v_records")) + "select id, clauses, total, short, prose_like, prose_signal from shaped",
        "route_by_quality": dirty_routes + "select id, status, reasons from routed",
        "reason_counts": dirty_routes + "select 'status' section, status as key, count(*) n from routed group by 2 union all select 'reason', r, count(*) from (select unnest(string_split(reasons, ',')) r from routed where reasons <> '') group by 2",
        "group_split": with_(R, splits()) + "select id, body_fingerprint, split from splits",
        "split_summary": with_(R, splits(), "g as (select split, body_fingerprint, count(*) n from splits group by 1, 2), gc as (select split, count(*) body_groups, count(*) filter (n > 1) multi_record_groups from g group by 1), a as (select count(*) total from splits)")
        + f"select s.split, cast(case s.split when 'train' then any_value(t) when 'validation' then any_value(v) else any_value(total) - any_value(t) - any_value(v) end as bigint) target, count(*) actual, round(count(*) / any_value(total), 6) ratio, {total('length(text)')} body_characters, any_value(body_groups) body_groups, any_value(multi_record_groups) multi_record_groups, count(distinct dynasty) categories from splits s join gc using (split) cross join goal cross join a group by s.split",
        "split_overlaps": overlaps(),
        "split_accounting": with_(R, broken(), "b as (select id, min(title || chr(1) || text) x from broken group by 1), s as (select id, title || chr(1) || text x from v_records)")
        + "select (select count(*) from s where id not in (select id from b)) missing, (select count(*) from b where id not in (select id from s)) extra, (select count(*) from s join b using (id) where s.x <> b.x) changed, (select cast(sum(n - 1) as bigint) from (select count(*) n from broken group by split, id)) repeated",
        "split_verdict": verdict_sql(),
        "sample_per_group": with_(R, splits())
        + f"select id, split, cast(length(text) as bigint) body_length from splits qualify row_number() over (partition by split order by sha256('{SEED}:' || id), id) <= case split {' '.join(f'when {q(k)} then {n}' for k, n in SAMPLE_SIZES.items())} end",
        "label_form": labelled + "select id, form from labelled",
        "keep_labelled": labelled + "select id, text, form from labelled where form is not null",
        "form_counts": labelled + "select coalesce(split, '<ALL>') split, coalesce(form, '<ALL>') form, count(*) n from labelled where form is not null group by rollup (split, form)",
        "verify_form": labelled + "select wanted, count(*) texts, count(*) filter (form = wanted) passed from labelled group by 1",
        "format_record": with_(P, label(), view_sql("v_formed"))
        + " union all ".join(f"select id, '{kind}' kind, {formatted(CLASSICAL, 'form')} formatted from {source}" for kind, source in (("text", "v_formed"), ("poem", "labelled"))),
        "build_vocab": with_(R, encoded()) + "select token, cast(id as bigint) id, cast(count as bigint) as count from vocab",
        "vocab_summary": with_(R, encoded())
        + f"select (select count(*) from splits where split = 'train') records, {total('case when id > 3 then count end')} as characters, count(*) filter (id > 3) regular, count(*) filter (id <= 3) special, count(*) size, count(*) filter (id > 3 and count = 1) seen_once from vocab",
        "encode": with_(R, encoded()) + f"select id, cast(len(toks) as bigint) n, {digest('toks')} tokens from tokens",
        "token_summary": with_(R, encoded()) + f"select split, count(*) records, {total('len(toks)')} tokens, {total('len(list_filter(toks, lambda z: z = 3))')} unknown_tokens, {total('2 * len(toks)')} bytes from tokens group by 1",
        "decode": with_(R, encoded()) + "select id, split, decoded from tokens",
        "token_offsets": with_(R, streams()) + "select id, split, cast(n as bigint) n, cast(tok_start as bigint) tok_start from placed_tokens",
        "next_token_windows": windows_sql(),
        "sample_windows": samples_sql(),
        "oov_report": with_(D, splits("v_dirty"), "known as (select list(distinct z) k from (select unnest(string_split(text, '')) z from splits where split = 'train'))")
        + f"select id, array_to_string(u, ',') unsupported, len(u) = 0 accepted from (select id, list_sort(list_filter(list_distinct({characters('text')}), lambda z: not list_contains(k, z))) u from v_dirty, known)",
        "screen_prompts": screen_sql(),
        "stage_funnel": dirty_routes + funnel([(s, "routed", f"routed where status = '{s}'") for s in ("clean", "review", "quarantine")]),
        "prepare_corpus": prepared_sql(),
    }
