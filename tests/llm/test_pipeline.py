import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline
from lodestrata.llm import quality
from lodestrata.llm.bpe import own_coder
from lodestrata.llm.common import materialize
from lodestrata.llm.pii import pseudonymise
from tests.llm.test_documents import brute_groups, brute_quality, brute_spans


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long_one = next(r for r in rows if r[1] and len(r[1].split()) > 300)
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, long_one[1] + " and more", "en", "s", 1), long_one, (None, long_one[1], "en", "s", 1)]
    source = spark.createDataFrame(rows, docs.schema)
    source.write.parquet(f"file://{tmp_path}/documents.parquet")

    frames, current = {}, source
    for name, stage in corpus_pipeline.STAGES:
        current = frames[name] = materialize(stage(spark, current, str(tmp_path)), name)
        if name != "best_fit_packing":
            assert current.columns == docs.columns

    def passes(r):
        m = dict(zip(quality.MEASURES, brute_quality(r[1])))
        return not any(eval(x.fails, {}, m) for x in quality.RULES if x.name in quality.POLICIES[corpus_pipeline.POLICY])

    want = [r for r in rows if passes(r)]
    key = lambda r: str(r[:2])
    assert sorted(map(tuple, frames["quality_rules"].collect()), key=key) == sorted(want, key=key)

    key_of = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
    leads: dict = {}
    numbered = [(i, *r[1:]) for i, r in enumerate(want)]
    groups = [g[2] for g in brute_groups(numbered, 5, 80)]
    for r, g in zip(want, groups):
        leads[g] = min(leads.get(g, r), r, key=key_of)
    want = list(dict.fromkeys(leads[g] for g in groups))
    assert sorted(map(tuple, frames["minhash_near_dedup"].collect()), key=key) == sorted(want, key=key)

    want = [(r[0], b[4].decode("utf-8", "ignore"), *r[2:4]) for r, b in zip(want, brute_spans(want))]
    want = [(*r, len(r[1])) for r in want]
    assert sorted(map(tuple, frames["suffix_array_dedup"].collect()), key=key) == sorted(want, key=key)

    private = pseudonymise(spark.createDataFrame(want, docs.schema), corpus_pipeline.KEY).select(*docs.columns).collect()
    want = [(*r[:4], len(r.text)) for r in private]
    assert sorted(map(tuple, frames["pii_pseudonyms"].collect()), key=key) == sorted(want, key=key)

    encode = own_coder(P.path("byte_bpe_50k.json"), P.PATTERN)[1]
    pieces = {}
    for r in frames["best_fit_packing"].collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id, r.piece] = (r.length, r.ids_crc32)
    for r in private:
        ids = np.append(encode(pa.array([r.text]))[0], 2).astype("<u4")
        cut = len(ids) - (len(ids) - 1) // 1024 * 1024
        bounds = [0, *range(cut, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            assert pieces.pop((r.doc_id, k)) == (b - a, zlib.crc32(ids[a:b].tobytes()))
    assert not pieces


def test_run(spark, sf):
    spark.conf.set(corpus_pipeline.KEY_SETTING, "another key")
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    spark.conf.unset(corpus_pipeline.KEY_SETTING)


def test_documents_may_have_columns_of_any_name(spark):
    odd = ["_found", "_new", "_kept", "_key", "kept_text", "text_key", "n_words", "failed", "row", "lead", "id", "spans", "pii_found", "a.b", "_hot", "cell"]
    words = " ".join(f"w{i} and" for i in range(60))
    texts = [words, words + " more", "mail a.b@example.com " + words.replace("w", "v"), words.replace("w", "u") + " " + words.replace("w", "v"), None, ""]
    values = [(i, x, "en", "s", 0, *(f"{i} {c}" for c in odd)) for i, x in enumerate(texts)] + [(None, texts[0], "en", "s", 0, *odd)]
    columns = ", ".join(f"`{c}` string" for c in odd)
    docs = spark.createDataFrame(values, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, same = stage(spark, docs, "").collect(), stage(spark, plain, "").collect()
        assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(map(tuple, same), key=str), name
        assert all(list(r.asDict()) == docs.columns and (r.doc_id is None or list(r)[5:] == [f"{r.doc_id} {c}" for c in odd]) for r in out)
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() == len(values)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), "").count() == 0, name
