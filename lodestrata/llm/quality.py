"""Quality rules as a bitmask ledger.

Every document is measured once and every rule evaluated once; the ledger keeps
the measurements and one bit per failed rule. Policies are versioned masks over
those bits, so a policy can be changed, compared or ablated by bitwise
operations on the ledger, without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestrata.llm.common import ship, text_chunks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where `fails` (SQL over the measures) is true."""

    bit: int
    name: str
    fails: str


#: A rule's bit never changes its meaning; new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "n_lines > 1 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 40 * n_words"),
    Rule(6, "many_repeated_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Policy version -> the rules it enforces.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines"),
    3: tuple(r.name for r in RULES[:6]),
    4: (*BASE, "symbols", "many_repeated_lines"),
}


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[x] for x in set(names))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    if len(names) == len(words):
        return 0
    pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    marked = np.zeros(len(words), bool)
    for shift in range(3):
        marked[shift : len(words) - 2 + shift] |= twice
    return int(marked.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes.split() cuts at exactly 0x20 and 0x09 to 0x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text or "") - len(raw) + len(raw.translate(None, _SPACE))
    return len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def ledger(docs: DataFrame) -> DataFrame:
    """docs' columns, the MEASURES (long), and `failed` (long): a bit per rule
    of RULES that the text fails.

    A null or empty text measures zero (it fails few_words). Rows don't depend on
    each other: repeated rows get equal entries, an empty table gives none. Columns
    of docs named as one of the ledger's are replaced. One scan, no shuffle.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in {*MEASURES, "failed"}]
    schema = docs.select(*kept).schema

    def run(batches):
        at = kept.index("text")
        for part in text_chunks(batches, "text"):
            found = np.array([measure(x) for x in part.column(at).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[:, i]) for i in range(len(MEASURES)))], [*kept, *MEASURES])

    out = StructType([*schema.fields, *(StructField(m, LongType()) for m in MEASURES)])
    failed = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in RULES), F.lit(0).cast("long"))
    return docs.select(*kept).mapInArrow(run, out).withColumn("failed", failed)


def passes(version: int) -> Column:
    """Whether a ledger entry passes a version of the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(entries: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: how many entries fail it (`failing`), and how
    many fail no other rule of the policy (`only_here`: what dropping it would let
    in). One aggregation by bit pattern (at most 2^rules rows), then bitwise."""
    policy = mask(POLICIES[version])
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy).cast("long")).alias("failed")).count()
    rules = [r for r in RULES if r.name in POLICIES[version]]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules))).alias("r")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed") == F.col("bit")
    return (
        patterns.select("failed", "count", each)
        .select("failed", "count", "r.*")
        .groupBy("rule")
        .agg(F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("failing"), F.sum(F.when(only, F.col("count")).otherwise(0)).alias("only_here"))
    )


def digest(docs: DataFrame, version: int = 2) -> DataFrame:
    """doc_id, the contract's measures, base_failed and kept of every row, and the
    bits of the rules that policy 3 has."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    entries = ledger(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (passes(1) & passes(version)).alias("kept"), F.col("failed").bitwiseAND(F.lit(mask(POLICIES[3])).cast("long")).alias("failed"))


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from t),
v as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from i),
p as (select doc_id, count(distinct i + d) as n from v, (values (0), (1), (2)) s(d) where c > 1 group by doc_id),
m as (select t.doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words from t left join p using (doc_id)),
f as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 25 * n_words then 4 else 0 end) + (case when n_lines > 1 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 40 * n_words then 32 else 0 end) as failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
    n_repeat_words::bigint as n_repeat_words, (failed & 3) <> 0 as base_failed, (failed & 15) = 0 as kept, failed::bigint as failed from f
"""
