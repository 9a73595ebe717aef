import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from terrapane.llm.common import documents
from terrapane.llm.registry import ORACLE_SQL, vocabulary_path
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_duplicates import classes
from tests.llm.test_quality_rules import rejected
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark, duck):
    con = duck()
    docs = con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()
    items = [t for (t,) in con.sql("SELECT text FROM benchmark").fetchall()]
    docs = [d for d in docs if not rejected(d[1])]
    first = classes(docs)
    docs = [d for d in docs if first[d[0]] == d[0]]
    grams = {g for x in items for w in [x.lower().split()] for g in zip(w, w[1:], w[2:])}
    near = lambda t: any(g in grams for w in [t.lower().split()] for g in zip(w, w[1:], w[2:]))  # noqa: E731  else no window is 0.8 equal
    docs = [d for d in docs if not (near(d[1]) and any(brute(d[1], x) for x in items))]
    con.sql("DROP VIEW documents")
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    copies = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op5_mixing']})").fetchall()}
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want, at = [], 0
    for d in docs:
        ids = t.encode(d[1], add_special_tokens=False).ids + [0]
        for _ in range(copies[d[0]]):
            want.append((d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_files"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, ties and clashing columns go through every stage; what each keeps is as its docstring says."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (None, good + " end", "en", None, 9), (2, None, "en", "a", 0), (2, None, "en", "a", 0), (3, "", None, None, None), (4, "short", "en", "b", 5), (5, "other " + " ".join(f"x{'abcdefgh'[i % 8]}{'klmnopqrst'[i // 8]}y" for i in range(80)), "en", "b", 5)]
    docs = frame(spark, rows)
    kept = {n: sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in s(spark, docs, SF).collect()) for n, s in corpus_pipeline.STAGES[:-1]}
    assert all(s(spark, docs, SF).columns == docs.columns for _, s in corpus_pipeline.STAGES[:-1])
    assert kept["quality_rules"] == [("1", "word0"), ("1", "word0"), ("5", "other"), ("None", "word0")]
    assert kept["near_duplicates"] == [("1", "word0"), ("2", "None"), ("2", "None"), ("3", ""), ("4", "short"), ("5", "other")]
    assert kept["decontamination"] == sorted((str(r[0]), str(r[1])[:5]) for r in rows)
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and len(kept["mixing"]) <= 3 * len(rows)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
