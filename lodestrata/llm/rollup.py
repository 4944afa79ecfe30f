"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revisions) becomes signed entries: a delete
takes back what the ledger holds of the document, a revision takes it back and
adds the new count. A batch's entries are summed by source, language and tokenizer
version; totals are the sum of the committed batches' deltas, so no total is ever
rewritten. A batch is committed by the success mark of its delta table: a batch
that is sent again does nothing, one that broke off is written anew.

The ledger's entries are divided by a hash of doc_id, so what a batch takes back is
looked up in the parts that can hold it. After every COMPACT batches the committed
ones are folded into a base (net entries and their totals), which is valid from the
success mark of its list of batches on; the base before it stays for its readers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm.bpe import CHUNK, library_coder
from lodestrata.llm.common import ship, text_chunks

KEYS = ("source", "lang", "tokenizer")
#: What entries and deltas add up; signed.
SUMS = ("n_docs", "n_tokens", "n_bytes")
#: Parts of the ledger, and batches after which they are folded into a base.
BUCKETS, COMPACT = 64, 8
ENTRY = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


def counted(docs: DataFrame, tokenizer: str, path: str, pattern: str) -> DataFrame:
    """An entry (n_docs 1) for every row of docs: its whole text's tokens and bytes
    (null: none) under a tokenizer version, whose added tokens count one each."""
    ship(docs.sparkSession)

    def run(batches):
        _, encode = library_coder(path, pattern, added=True)
        for part in text_chunks(batches, "text", CHUNK):
            counts = encode(part.column(3))[1]
            sizes = [len((x or "").encode()) for x in part.column(3).to_pylist()]
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array([tokenizer] * n, pa.string()), pa.array(np.ones(n, np.int64)), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "source", "lang", "tokenizer", "n_docs", "n_tokens", "n_bytes"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "source", "lang", "text").mapInArrow(run, ENTRY)


class TokenRollup:
    """Ledger and rollups in one folder. tokenizers: version -> (path, pattern)."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, tuple[str, str]]):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.folder}/deltas/{batch}/_SUCCESS")

    def batches(self) -> list[str]:
        """Names of the committed batches, in order of name."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in files.listStatus(root)) if files.exists(root) else []
        return [x for x in names if self.committed(x)]

    def _bases(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/base")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [int(x.getPath().getName()) for x in files.listStatus(root)] if files.exists(root) else []
        return sorted(x for x in names if self._exists(f"{self.folder}/base/{x}/names/_SUCCESS"))

    def _folded(self, base: int) -> set[str]:
        return {r["name"] for r in self.spark.read.parquet(f"{self.folder}/base/{base}/names").collect()}  # a row a batch

    def _paths(self, kind: str) -> list[str]:
        """Where the committed entries or deltas are: the newest base, and the batches after it."""
        bases = self._bases()
        folded = self._folded(bases[-1]) if bases else set()
        return [f"{self.folder}/base/{n}/{kind}" for n in bases[-1:]] + [f"{self.folder}/{kind}/{x}" for x in self.batches() if x not in folded]

    def _read(self, kind: str) -> DataFrame | None:
        ddl = ENTRY + ", bucket int" if kind == "entries" else ENTRY.removeprefix("doc_id long, ")
        parts = [self.spark.read.schema(ddl).parquet(x) for x in self._paths(kind)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _write_entries(self, entries: DataFrame, path: str) -> None:
        bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", "n_bytes")), F.lit(BUCKETS)).cast("int")
        entries.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def compact(self) -> int | None:
        """Fold all committed batches into a new base; its number, None without batches."""
        names = self.batches()
        if not names:
            return None
        bases = self._bases()
        n = bases[-1] + 1 if bases else 0
        sums = [F.sum(c).alias(c) for c in SUMS]
        held = self._read("entries").groupBy("doc_id", *KEYS).agg(*sums).where(" or ".join(f"{c} <> 0" for c in SUMS))
        self._write_entries(held, f"{self.folder}/base/{n}/entries")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base/{n}/deltas")
        self.spark.createDataFrame([(x,) for x in names], "name string").write.mode("overwrite").parquet(f"{self.folder}/base/{n}/names")
        gone = [f"entries/{x}" for x in (self._folded(bases[-1]) if bases else ())] + [f"base/{x}" for x in bases[:-1]]
        for name in gone:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return n

    def commit(self, batch: str, changes: DataFrame, versions: list[str] | None = None) -> bool:
        """Apply changes (change, doc_id, source, lang, text) under a batch name;
        change is insert, delete or revise. False if the batch was committed before.
        One writer at a time: batches that are committed together don't see each other.

        Repeated inserts are documents of their own. A delete or revision of an
        unknown or null doc_id takes nothing back; a revision still adds its count.
        Deleting needs no text. Changes of a batch have no order: all its deletes and
        revisions take back what earlier batches hold, and of several revisions of one
        doc_id the greatest by text, source and lang (null: least) counts. So a document
        that a batch both inserts and deletes is there afterwards, once for each insert.
        Texts may be of any length; no changes make an empty batch; columns besides the
        five play no part.
        `versions`: tokenizer versions to count, else all.
        """
        if self.committed(batch):
            return False
        given = changes.selectExpr("change", "cast(doc_id as long) doc_id", "source", "lang", "text")
        latest = given.where("change = 'revise' and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "source", "lang")).alias("new"))
        added = given.where("change = 'insert' or (change = 'revise' and doc_id is null)").drop("change").unionByName(latest.select("doc_id", "new.*"))
        entries = reduce(DataFrame.unionByName, [counted(added, v, *self.tokenizers[v]) for v in versions or sorted(self.tokenizers)])
        held = self._read("entries")
        if held is not None:
            gone = given.where("change in ('delete', 'revise') and doc_id is not null").select("doc_id").distinct()
            parts = [r["bucket"] for r in gone.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()]  # BUCKETS at most
            held = held.where(F.col("bucket").isin(parts))
            held = held.where(F.col("tokenizer").isin(versions)) if versions else held
            net = held.join(gone, "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0")
            entries = entries.unionByName(net.select("doc_id", *KEYS, *((-F.col(c)).alias(c) for c in SUMS)))
        self._write_entries(entries, f"{self.folder}/entries/{batch}")
        summed = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/{batch}").groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        summed.write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        if len(self._paths("deltas")) > COMPACT:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_bytes over the committed
        batches; groups without documents have no row."""
        deltas = self._read("deltas")
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long")
        return deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0")
