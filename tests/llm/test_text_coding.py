import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import bpe, queries
from lodestrata.llm.packing import best_fit, local_search, pack_documents
from lodestrata.llm.rollup import TokenRollup, counted

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", None, "   ", "a  b   c ", "  lead", " \n x\n\n y", "a\x1c\x1c b", "a \x1c b", "x" * 700, "ab" * 900 + " " * 500 + "é" * 400, "日本語テキスト " * 30, "<|endoftext|> hi", " 's 'll  're", "\t\t a", "a\xa0 \xa0b", "á́   b", "\U0001f600" * 9]


def random_texts(n):
    r = random.Random(7)
    return ["".join(r.choice(" \n\tabcdeE'sréñ.,12\x1c 日\x85᠎​") for _ in range(r.randint(1, 60))) for _ in range(n)]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[b - n : b].tolist() for b, n in zip(ends, counts)]


def test_ids_are_those_of_the_libraries():
    texts = ODD + random_texts(1500)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    model, encode = bpe.own_coder(RANKS, P.PATTERN)
    ids, counts = encode(pa.array(texts))
    assert split(ids, counts) == [reference.encode_ordinary(x or "") for x in texts]
    assert model.decode(ids).tobytes() == "".join(x or "" for x in texts).encode()
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    wanted = [x.ids for x in other.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for kind in (bpe.own_coder, bpe.library_coder):
        assert split(*kind(JSON, P.PATTERN)[1](pa.array(texts))) == wanted


def test_patterns_whose_tokens_cross_spaces():
    pattern, texts = r"[a-z ]+|.|\n", ["one two three", "a b", None, "x  y z"]
    ranks = {bytes([b]): b for b in range(256)} | {b"e ": 256, b"e t": 257}
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    model = bpe.RankBPE(ranks, bpe.pairs_of_ranks(ranks))

    def encode_parts(strings, together):
        parts = strings.to_pylist()
        ids = [i for x in (["".join(parts)] if together else parts) for i in reference.encode_ordinary(x)]
        return np.array(ids, np.int64), bpe.by_string(model, np.array(ids, np.int64), strings)

    assert split(*bpe.TextCoder(encode_parts)(pa.array(texts))) == [reference.encode_ordinary(x or "") for x in texts]


def test_added_tokens_are_those_of_the_library():
    end = "<|endoftext|>"
    texts = [*ODD, end, end * 3, f"a  {end}\n b", f" {end} {end} x", f"x<|endoftext{end}|> 's", f"{end[:-1]} >", *(end.join(random_texts(5)) for _ in range(40)), *random_texts(100)]
    other = Tokenizer.from_file(JSON)
    wanted = [x.ids for x in other.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert split(*bpe.library_coder(JSON, P.PATTERN, added=True)[1](pa.array(texts))) == wanted
    for few in ([], [None], ["", None, end]):
        assert bpe.library_coder(JSON, P.PATTERN, added=True)[1](pa.array(few, pa.string()))[1].tolist() == [int(x == end) for x in few]


def test_packing_and_rollup_know_added_tokens(spark, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    docs = spark.createDataFrame([(1, "a <|endoftext|> hi", "s", "en")], "doc_id long, text string, source string, lang string")
    docs.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    wanted = [*Tokenizer.from_file(JSON).encode("a <|endoftext|> hi", add_special_tokens=False).ids, 2]
    for rows in (queries.op2_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        assert [(r.length, r.ids_crc32) for r in rows.collect()] == [(len(wanted), zlib.crc32(np.array(wanted, "<u4").tobytes()))]
    assert {r.n_tokens for r in queries.op8_token_rollup(spark, str(tmp_path)).where("tokenizer = 'byte_bpe_50k'").collect()} == {len(wanted) - 1}


def test_no_texts():
    for texts in ([], [None], ["", ""]):
        ids, counts = bpe.own_coder(RANKS, P.PATTERN)[1](pa.array(texts, pa.string()))
        assert len(ids) == 0 and counts.tolist() == [0] * len(texts)


def frame(spark, texts):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)], "doc_id long, text string, ids long, length long")


def test_encode_decode(spark):
    texts = ODD + random_texts(50) + [ODD[3], ODD[3]]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts), RANKS, P.PATTERN).collect()}
    assert all(bytes(got[i].decoded) == (x or "").encode() and got[i].n_tokens == len(got[i].ids) // 4 for i, x in enumerate(texts))
    assert bpe.encode_decode(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_packing_keeps_every_token_in_its_place(spark):
    texts = ODD + random_texts(300) + ["word and another one, " * 400] * 3 + ["short text of some words " * k for k in range(1, 60)]
    model, encode = bpe.own_coder(JSON, P.PATTERN)
    rows = pack_documents(frame(spark, texts), JSON, P.PATTERN).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, ids in enumerate(split(*encode(pa.array(texts)))):
        ids = np.array([*ids, 2], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == np.cumsum([0, *(r.length for r in members)])[:-1].tolist() and sum(r.length for r in members) <= 1024
    assert len(bins) <= -(-total // 1024) + 1
    assert pack_documents(frame(spark, []), JSON, P.PATTERN).count() == 0


def test_local_search_improves_and_keeps_all():
    r = random.Random(5)
    for _ in range(30):
        lengths = [r.randint(100, 700) for _ in range(60)]
        worst = [[i] for i in range(60)]
        out = local_search(lengths, worst, 1024)
        assert sorted(i for b in out for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 1024 for b in out)
        assert len(out) < 60
        assert len(local_search(lengths, best_fit(lengths, 1024), 1024)) <= len(best_fit(lengths, 1024))


def test_rollup(spark, tmp_path):
    versions = {"a": (JSON, P.PATTERN), "b": (RANKS, P.PATTERN)}
    rollup = TokenRollup(spark, f"file://{tmp_path}/r", versions)
    assert rollup.totals().count() == 0
    ddl = "change string, doc_id long, source string, lang string, text string"
    texts = {1: ("s", "en", "one two three"), 2: ("s", "en", "four five"), 3: (None, None, None), 4: ("t", "de", "")}
    load = spark.createDataFrame([("insert", i, *x) for i, x in texts.items()] + [("insert", 2, *texts[2])], ddl)
    assert rollup.commit("1", load) and not rollup.commit("1", load)

    def brute(docs):
        out = {}
        for name, (path, pattern) in versions.items():
            encode = bpe.own_coder(path, pattern)[1]
            for source, lang, text in docs:
                n = int(encode(pa.array([text], pa.string()))[1][0])
                old = out.get((source, lang, name), (0, 0, 0))
                out[source, lang, name] = (old[0] + 1, old[1] + n, old[2] + len((text or "").encode()))
        return out

    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}
    assert totals() == brute([*texts.values(), texts[2]])
    changes = spark.createDataFrame([("delete", 2, None, None, None), ("revise", 1, "s", "fr", "quite another text here"), ("delete", 77, None, None, None), ("delete", None, None, None, None)], ddl)
    assert rollup.commit("2", changes) and not rollup.commit("2", changes)
    assert totals() == brute([("s", "fr", "quite another text here"), texts[3], texts[4]])
    # a batch that broke off before its mark is written anew
    spark.range(3).write.parquet(f"file://{tmp_path}/r/entries/3")
    assert rollup.commit("3", spark.createDataFrame([("insert", 9, "s", "fr", "x")], ddl))
    assert totals()["s", "fr", "a"][0] == 2


def test_rollup_of_a_whole_table_with_deletes_and_revisions(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rollup = TokenRollup(spark, f"file://{tmp_path}/r", queries.TOKENIZERS)

    def totals(df):
        return sorted((*(x or "" for x in r[:3]), *r[3:]) for r in df.select("source", "lang", "tokenizer", "n_docs", "n_tokens", "n_bytes").collect())

    def wanted(rows):
        counts = [counted(rows, name, *queries.TOKENIZERS[name]) for name in queries.TOKENIZERS]
        counts[0].unionByName(counts[1]).createOrReplaceTempView("counts_of_all")
        return totals(spark.sql("select source, lang, tokenizer, count(*) n_docs, sum(n_tokens) n_tokens, sum(n_bytes) n_bytes from counts_of_all group by all"))

    docs.createOrReplaceTempView("all_documents")
    changed = spark.sql("select doc_id, if(doc_id % 7 = 1, lang, source) source, lang, if(doc_id % 7 = 1, substr(text, 1, length(text) div 2), text) text from all_documents where doc_id % 7 <> 0 or doc_id is null")
    done = [rollup.commit(*batch) for batch in queries.rollup_batches(docs)[:4]]
    assert done == [True, True, False, True] and totals(rollup.totals()) == wanted(changed) != wanted(docs)
    assert totals(queries.op8_token_rollup(spark, path)) == wanted(docs)


def test_of_repeated_revisions_one_counts(spark, tmp_path):
    ddl = "change string, doc_id long, source string, lang string, text string"
    rollup = TokenRollup(spark, f"file://{tmp_path}/r", {"a": (JSON, P.PATTERN)})
    rollup.commit("1", spark.createDataFrame([("insert", 1, "s", "en", "one")], ddl))
    rollup.commit("2", spark.createDataFrame([("revise", 1, "s", "en", "a b"), ("revise", 1, "s", "en", "b c d"), ("revise", 1, "s", "en", None), ("revise", None, "s", "en", "x"), ("revise", None, "s", "en", "x")], ddl))
    assert [(r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()] == [(3, 5, 7)]


def test_compacted_rollups(spark, tmp_path, monkeypatch):
    from lodestrata.llm import rollup as module

    monkeypatch.setattr(module, "COMPACT", 2)
    ddl = "change string, doc_id long, source string, lang string, text string"
    rollup = TokenRollup(spark, f"file://{tmp_path}/r", {"a": (JSON, P.PATTERN)})
    assert rollup.compact() is None
    held: list = []
    r = random.Random(3)
    for k in range(9):
        gone, new = {r.randint(0, 9) for _ in range(2)}, [r.randint(0, 9) for _ in range(3)]
        rows = [("delete", i, None, None, None) for i in gone] + [("insert", i, "s", None, "a b" * (i + k)) for i in new] + [("insert", None, "s", "x", "c")] + [("delete", 77, None, None, None)]
        assert rollup.commit(f"{k:02}", spark.createDataFrame(rows, ddl)) and not rollup.commit(f"{k:02}", spark.createDataFrame(rows, ddl))
        held = [x for x in held if x[0] not in gone] + [(i, "s", None, "a b" * (i + k)) for i in new] + [(None, "s", "x", "c")]
        got = {(x.source, x.lang): (x.n_docs, x.n_bytes) for x in rollup.totals().collect()}
        want: dict = {}
        for _, s, l, t in held:
            n, b = want.get((s, l), (0, 0))
            want[s, l] = n + 1, b + len(t)
        assert got == want
    assert len(rollup._paths("entries")) <= 3 and len(rollup._bases()) <= 2
    empty = spark.createDataFrame([], ddl)
    assert rollup.commit("99", empty) and {(x.source, x.lang): (x.n_docs, x.n_bytes) for x in rollup.totals().collect()} == want


def test_an_insert_and_a_deletion_in_one_batch(spark, tmp_path):
    ddl = "change string, doc_id long, source string, lang string, text string, bucket string"
    rollup = TokenRollup(spark, f"file://{tmp_path}/r", {"a": (JSON, P.PATTERN)})
    rollup.commit("1", spark.createDataFrame([("insert", 1, "s", "en", "one", "x"), ("insert", 1, "s", "en", "one", "x")], ddl))
    rollup.commit("2", spark.createDataFrame([("insert", 1, "s", "en", "two", "x"), ("delete", 1, None, None, None, None), ("delete", 1, None, None, None, None)], ddl))
    assert [(r.n_docs, r.n_bytes) for r in rollup.totals().collect()] == [(1, 3)]
