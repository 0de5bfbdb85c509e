import random
import re

import corpus_pipeline as P
from helpers import SCHEMA, corpus, jaccard_rows
from test_fertility import brute as quality
from test_mixing import brute as mix_of
from test_packing import check as check_packing
from tidelog.llm import fertility, mixing, packing


def documents():
    rnd = random.Random(21)
    rows = corpus(120, seed=21, vocabulary=500, least=30, most=160)
    out = []
    for i, t, lang, source, n in rows:
        if t and rnd.random() < 0.2:
            t += f"\npassword = {'ab3' * rnd.randint(2, 8)} AKIA{'X9' * 9}"
        out.append((i, t, lang, source, n))
    return out


def test_every_stage_against_its_model(spark, monkeypatch):
    # made-up words are poorer than prose; the bands of the fixture leave some texts on either side
    monkeypatch.setattr(fertility, "BANDS", {k: fertility.Band((0.5, 9.0), 0.5, 5.6) for k in fertility.BANDS})
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = rows

    kept = P.quality_rules(spark, docs, "")
    held = [r for r in held if quality(r[1], r[2])[-1]]
    assert kept.columns == docs.columns and 20 < len(held) < len(rows)
    assert sorted(map(tuple, kept.collect())) == sorted(held)

    kept = P.near_duplicates(spark, spark.createDataFrame(held, SCHEMA), "")
    first = {i for i, _, component in jaccard_rows(held) if i == component}
    assert len(first) < len(held)
    held = [r for r in held if r[0] in first]
    assert sorted(map(tuple, kept.collect())) == sorted(held)

    masked = sorted(map(tuple, P.secret_scans(spark, spark.createDataFrame(held, SCHEMA), "").collect()))
    for new, old in zip(masked, sorted(held), strict=True):
        assert new[0] == old[0] and new[2:] == old[2:] and len(new[1]) == len(old[1])
        assert not re.search(r"AKIA[A-Z0-9]{14}|password = [a-z0-9]{12}", new[1])
        assert all(a == b or a == "*" for a, b in zip(new[1], old[1], strict=True))
    held = masked

    mixed = P.mixing_sources(spark, spark.createDataFrame(held, SCHEMA), "")
    want = sorted(x[0] for x in mix_of(held, mixing.PRODUCTION))
    got = sorted(map(tuple, mixed.collect()))
    assert [r[0] for r in got] == want and set(got) <= set(held)

    pieces = packing.pack(spark.createDataFrame([(k, r[1]) for k, r in enumerate(got)], "doc_id long, text string").coalesce(1), with_ids=True).collect()
    check_packing(pieces, [r[1] for r in got], packing.Limits())


def test_run_is_its_stages(spark, tmp_path):
    spark.createDataFrame(documents()[:40], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, P.run(spark, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    texts = [
        (5, one), (5, one), (3, one + " z"), (3, one + " z"), (None, one),  # one group: the row of id 3, once
        (None, two), (None, two), (None, two + " z"),  # null ids only: one of them
        (7, three), (7, three + " z"), (7, "other words stand here and link with nothing"),  # unlinked texts of an id both stay
        (8, ""), (8, ""), (9, ""), (9, None), (9, None), (None, " "), (None, " "),  # without words: equal rows only
    ]
    rows = [(i, t, "en", "src0", 0) for i, t in texts]
    for parts in (1, 4):
        got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), "").collect()]
        assert len([1 for _, t in got if t and t.startswith("a0")]) == 1 and (3, one + " z") in got
        assert [i for i, t in got if t and t.startswith("b0")] == [None]
        assert [i for i, t in got if t and t.startswith("c0")] == [7]
        rest = [x for x in got if not (x[1] and x[1][:2] in ("a0", "b0", "c0"))]
        assert sorted(rest, key=str) == sorted([(7, texts[10][1]), (8, ""), (9, ""), (9, None), (None, " ")], key=str)


def test_stages_with_nulls_clashing_names_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(fertility, "BANDS", {k: fertility.Band((0.1, 99.0), 1.0, 0.0) for k in fertility.BANDS})
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(None, words, None, None, 1), (1, None, "en", "src0", 2), (2, words + " more", "en", "src1", 3), (2, words + " more", "en", "src1", 4), (3, "", "de", None, 5)]
    odd = ["kept", "secret_spans", "mix_tokens", "component_id", "__row", "c0", "n_words"]
    docs = spark.createDataFrame([(*r, *[f"{c}-{r[4]}" for c in odd]) for r in rows], SCHEMA + "".join(f", {c} string" for c in odd))
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        got = [tuple(r) for r in got.collect()]
        want = {tuple(r) for r in docs.collect()}
        assert got and set(got) <= want, name
        assert stage(spark, docs.limit(0), "").collect() == [], name
    assert len(P.packed(spark, docs, "").collect()) >= len(rows)
    assert P.packed(spark, docs.limit(0), "").collect() == []
