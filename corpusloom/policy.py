"""Rules of a language or collection as data; operators take them as an argument."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of markup and addresses.
HTML = r"<[^>\n]{1,200}>"
URL = r"(?:https?://|www\.)"


@dataclass(frozen=True)
class Policy:
    """Values of every rule. Empty lists and None switch a rule off."""

    name: str
    #: Categories: fit for use, known but unfit, and all that validation knows.
    allowed: tuple[str, ...]
    unfit: tuple[str, ...]
    known: tuple[str, ...]
    id_format: str
    id_pattern: str
    # Thresholds and ASCII classes of the rules, from here on.
    min_length: int = 8
    note_length: int = 500
    review_length: int = 1000
    max_length: int = 5000
    validation_markers: tuple[str, ...] = ()
    profile_markers: tuple[str, ...] = ()
    body_markers: tuple[str, ...] = ()
    title_markers: tuple[str, ...] = ()
    html: str = HTML
    url: str = URL
    ascii_alnum: str | None = r"[A-Za-z0-9]"
    ascii_punctuation: str | None = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
    placeholder: str | None = None
    corruption: str | None = None
    source_explanation: str | None = None
    citation: str | None = None
    title_suffixes: tuple[str, ...] = ()
    prose_signals: tuple[str, ...] = ()
    latin_rules: bool = True
    latin_share: float = 0.25
    latin_least: int = 20
    prefix_length: int = 80
    prefix_latin: int = 15
    clause_marks: str = ",.!?;:"
    prose_least: int = 80
    prose_clauses: int = 6
    prose_mean: float = 10.0
    short_clause: int = 8
    prose_short_share: float = 0.35
    punctuation: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, str, str, str, str] = ("form: ", "category: ", "author: ", "title: ", "text: ")
    forms: tuple[tuple[int, int, str], ...] = ()
    form_comma: str = ","
    form_stops: str = ".!?"


_ANCIENT = ("先秦", "两汉", "魏晋", "南北朝", "隋朝", "唐朝", "五代", "宋朝", "元朝", "明朝", "清朝")
_MODERN = ("近代", "现代")

# The lists, marks and patterns of the classical Chinese collection.
CLASSICAL = Policy(
    name="classical",
    allowed=_ANCIENT,
    unfit=_MODERN,
    known=("", *_ANCIENT, *_MODERN),
    id_format="poem-%07d",
    id_pattern=r"\Apoem-\p{Nd}{7}\n?\z",
    validation_markers=("相关成语", "相关楹联", "词句解析", "英文翻译", "白话译文", "出自", "注释", "赏析", "译文", "更多关于"),
    profile_markers=("相关成语", "注释", "赏析", "译文", "英文翻译", "词句解析", "出自", "更多关于", "相关楹联"),
    body_markers=("相关成语", "相关楹联", "词句解析", "词句注释", "英文翻译", "白话译文", "创作背景", "作品鉴赏", "更多关于", "注释", "赏析", "译文"),
    title_markers=("日记", "游记", "全文讲解", "白话译文", "英文翻译", "作品赏析", "课文解析"),
    placeholder="[□＿]",
    corruption="[¤＋＜─■○●〓囗]",
    source_explanation=r"出自[^。！？\n]{0,40}《[^》]{1,80}》",
    citation="[（(]《[^》]{1,100}》",
    title_suffixes=("表", "策", "论", "传", "记", "序", "疏"),
    prose_signals=("曰：", "曰:", "“", "　　"),
    clause_marks="，。！？；：",
    punctuation={"﹐": "，", "︐": "，", "﹒": "。", "．": "。", "﹔": "；", "︔": "；", "﹕": "：", "︓": "：", "﹖": "？", "﹗": "！"},
    labels=("体裁：", "朝代：", "作者：", "题目：", "正文："),
    forms=((4, 5, "五言绝句"), (4, 7, "七言绝句"), (8, 5, "五言律诗"), (8, 7, "七言律诗")),
    form_comma="，",
    form_stops="。！？",
)

LATIN_SCRIPT = Policy(
    name="latin",
    allowed=("de", "en", "fr"),
    unfit=(),
    known=("", "de", "en", "fr"),
    id_format="poem-%07d",
    id_pattern=CLASSICAL.id_pattern,
    validation_markers=("copyright", "license"),
    profile_markers=("copyright", "license"),
    body_markers=("copyright", "license"),
    title_markers=("The",),
    placeholder=CLASSICAL.placeholder,
    corruption=CLASSICAL.corruption,
    source_explanation=CLASSICAL.source_explanation,
    citation=CLASSICAL.citation,
    title_suffixes=("en", "er", "ion"),
    prose_signals=("the",),
    ascii_alnum=None,
    ascii_punctuation=None,
    latin_rules=False,
    punctuation=CLASSICAL.punctuation,
)

#: One policy for all rows, or one for each value of a column.
Policies = Policy | Mapping[str, Policy]


def by_kind(policies: Policies, kind: Column | None, body: Callable[[Policy], Column]) -> Column:
    """``body`` of the policy that ``kind`` names, so that one pass serves several; a kind without a policy fails the job."""
    if isinstance(policies, Policy):
        return body(policies)
    unknown = F.raise_error(F.concat(F.lit("no policy for "), F.coalesce(kind, F.lit("null"))))
    chosen = None
    for name, policy in policies.items():
        chosen = F.when(kind == name, body(policy)) if chosen is None else chosen.when(kind == name, body(policy))
    return chosen.otherwise(unknown)
