"""Character vocabularies, token ids and checks against a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import hash_bucket, prefix_sum
from corpusloom.operators.profile import char_frequency
from corpusloom.policy import Policy
from corpusloom.sources.shared import bounded_batches, materialize

# The special tokens, in the order of their ids.
SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD, BOS, EOS, UNK = range(4)


def format_record(policy: Policy, form: Column, category: Column, author: Column, title: Column, text: Column) -> Column:
    """The text of a record as the model sees it; the form's line only where there is one."""
    f, c, a, t, b = policy.labels
    head = F.when(F.coalesce(form, F.lit("")) != "", F.concat(F.lit(f), form, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit(c), category, F.lit(f"\n{a}"), author, F.lit(f"\n{t}"), title, F.lit(f"\n{b}"), text)


def build_vocab(texts: DataFrame, text: str = "formatted") -> DataFrame:
    """(token, id, count): specials first, then the characters in code-point order. Rows: distinct characters."""
    spark = texts.sparkSession
    counts = char_frequency(texts, text)
    ids = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("character")) + (len(SPECIALS) - 1)
    regular = counts.select(F.col("character").alias("token"), ids.cast("int").alias("id"), F.col("n").alias("count"))
    special = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, count long")
    return special.unionByName(regular)


def vocab_summary(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: records, characters, regular, special, size, seen once."""
    regular = F.col("id") >= len(SPECIALS)
    sizes = vocab.agg(
        F.coalesce(F.sum(F.when(regular, F.col("count"))), F.lit(0)).alias("characters"),
        F.count_if(regular).alias("regular"),
        F.count_if(~regular).alias("special"),
        F.count("*").alias("size"),
        F.count_if(regular & (F.col("count") == 1)).alias("seen_once"),
    )
    return texts.agg(F.count("*").alias("records")).crossJoin(sizes)  # one row each


def encode(df: DataFrame, vocab: DataFrame, text: str = "formatted", out: str = "tokens", bos: bool = True, eos: bool = True) -> DataFrame:
    """``df`` with the ids of ``text``'s characters; unknown ones get <unk>, a null text has no characters.

    The vocabulary is as large as the number of distinct characters, at most all of
    Unicode; it goes to the tasks as one array over code points.
    """
    rows = vocab.where(F.col("id") >= len(SPECIALS)).select("token", "id").collect()
    table = np.full(0x110000, UNK, np.int32)
    for r in rows:
        table[ord(r.token)] = r.id
    shared = df.sparkSession.sparkContext.broadcast(table)
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch, "")
            codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False) + (bos + eos), dtype=np.int64)
            at = np.concatenate(([0], ends))
            out, inner = np.empty(at[-1], np.int32), np.ones(at[-1], bool)
            for some, place, special in ((bos, at[:-1], BOS), (eos, at[1:] - 1, EOS)):
                if some:
                    out[place], inner[place] = special, False
            out[inner] = shared.value[codes]
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))

    return df.withColumn(out, ids(F.col(text).cast("string")))


def encode_by_join(df: DataFrame, vocab: DataFrame, key: str = "id", text: str = "formatted") -> DataFrame:
    """The same by a join with the vocabulary, a row for each character; for checks."""
    exploded = df.select(key, F.posexplode(T.characters(F.col(text))).alias("pos", "token"))
    known = exploded.join(F.broadcast(vocab.select("token", F.col("id").alias("__id"))), "token", "left")
    lists = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("__id", F.lit(UNK)).alias("i")))).alias("l"))
    return lists.select(key, F.concat(F.array(F.lit(BOS)), F.transform("l", lambda x: x["i"]), F.array(F.lit(EOS))).alias("tokens"))


def token_summary(encoded: DataFrame) -> DataFrame:
    """A row for each split: records, tokens, unknown tokens, bytes of the 16-bit form."""
    unknown = F.size(F.filter("tokens", lambda x: x == UNK))
    return encoded.groupBy("split").agg(F.count("*").alias("records"), F.sum(F.size("tokens")).alias("tokens"), F.sum(unknown).alias("unknown_tokens"), (2 * F.sum(F.size("tokens"))).alias("bytes"))


def decode(encoded: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "decoded", skip_special: bool = True) -> DataFrame:
    """``encoded`` with the text of its ids; specials are left out or shown."""
    ordered = vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: x["token"]).alias("__vocab"))
    ids = F.filter(tokens, lambda i: i >= len(SPECIALS)) if skip_special else F.col(tokens)
    text = F.array_join(F.transform(ids, lambda i: F.element_at(F.col("__vocab"), i + 1)), "")
    return encoded.crossJoin(F.broadcast(ordered)).withColumn(out, text).drop("__vocab")  # one row


def token_offsets(records: DataFrame, key: str = "id", seed: int = 42, size: Column | None = None, among: str = "tokens") -> DataFrame:
    """``records`` with tok_start: where each record begins in its split's stream, in seeded order.

    Keys and sizes are numbered; records meet their place by a join. ``size`` says how
    many ids a record has, by default those in ``tokens``. A table of tokens is written
    first, as both sides need it; given a ``size``, records are read as they are, and
    may be encoded after they were placed. Records of one split and key are numbered
    as one and follow each other by ``among``.
    """
    if size is None:
        records, size = materialize(records, "encoded"), F.size("tokens")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    sizes = records.groupBy("split", key).agg(F.sum(size).alias("__size"), F.count("*").alias("__k"))
    sizes = materialize(T.bind(sizes, __order=order), "sizes")
    placed = prefix_sum(sizes, ["__order", key], F.col("__size"), "__first", by=["split"], bucket=hash_bucket(F.col("__order"), sizes.count()))
    met = records.join(placed.select("split", key, "__first", "__k"), ["split", key])
    columns = [*map(T.named, records.columns), "tok_start"]
    single = met.withColumn("tok_start", F.col("__first")).where("__k = 1").select(*columns)
    if not sizes.where("__k > 1").head(1):
        return single
    # Only keys that repeat are ordered among themselves.
    again = Window.partitionBy("split", key).orderBy(among).rowsBetween(Window.unboundedPreceding, -1)
    several = met.where("__k > 1").withColumn("tok_start", F.col("__first") + F.coalesce(F.sum(size).over(again), F.lit(0)))
    return single.unionByName(several.select(*columns))


def known_characters(vocab: DataFrame) -> np.ndarray:
    """A bit for each code point: at most all of Unicode, 139 kB."""
    known = np.zeros(0x110000, bool)
    known[[ord(r.token) for r in vocab.where(F.col("id") >= len(SPECIALS)).select("token").collect()]] = True
    return np.packbits(known)


def unknown_characters(df: DataFrame, vocab: DataFrame, text: Column, out: str = "unsupported") -> DataFrame:
    """``df`` with the sorted distinct characters of ``text`` that the vocabulary lacks; a null text has a null list.

    Every character looks up its bit, so the time does not depend on the vocabulary.
    """
    shared = df.sparkSession.sparkContext.broadcast(known_characters(vocab))

    @F.pandas_udf("array<string>")
    def missing(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            codes = (None if t is None else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in batch)
            yield pd.Series([None if c is None else [chr(x) for x in np.unique(c[~known[c]])] for c in codes], dtype=object)

    return df.withColumn(out, missing(text))


def oov_report(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with unsupported characters and ``accepted`` where there are none."""
    return unknown_characters(df, vocab, F.col(text)).withColumn("accepted", F.size("unsupported") == 0)


# What a request may hold.
LIMITS = {"dynasty": (1, 16), "author": (1, 32), "title": (1, 64)}
SAMPLES, TOP_K, SEED = (1, 5), (1, 200), (0, 2**31 - 1)
TEMPERATURE, PENALTY = (0.0, 2.0), (1.0, 2.0)


def screen_prompts(requests: DataFrame, vocab: DataFrame, policy: Policy) -> DataFrame:
    """``requests`` with the prompt, the reasons against them and ``accepted``.

    A null seed is allowed; any other null fails its check.
    """
    ok = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [("invalid_form", ok(F.col("form").isin(*(n for _, _, n in policy.forms))))]
    rules += [(f"invalid_{c}", ok(F.length(c).between(*b))) for c, b in LIMITS.items()]
    rules += [
        ("invalid_samples", ok(F.col("samples").between(*SAMPLES))),
        ("invalid_temperature", ok((F.col("temperature") > TEMPERATURE[0]) & (F.col("temperature") <= TEMPERATURE[1]))),
        ("invalid_top_k", ok(F.col("top_k").between(*TOP_K))),
        ("invalid_repetition_penalty", ok(F.col("repetition_penalty").between(*PENALTY))),
        ("invalid_seed", F.col("seed").isNotNull() & ~F.col("seed").between(*SEED)),
    ]
    prompted = requests.withColumn("prompt", format_record(policy, F.col("form"), F.col("dynasty"), F.col("author"), F.col("title"), F.lit("")))
    checked = unknown_characters(prompted, vocab, F.coalesce("prompt", F.lit("")))
    rules.append(("unsupported_characters", F.size("unsupported") > 0))
    return checked.withColumn("reasons", T.reasons(rules)).withColumn("accepted", F.size("reasons") == 0)
