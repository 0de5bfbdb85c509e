import random
import re

from tidelog.llm import license_scan as L
from tidelog.llm.license_rules import BASE, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))


def test_base_against_words(spark):
    rnd = random.Random(3)
    parts = "under the mit license apache version 2 cc by nc CC-BY-NC Apache, License; é über 2.0 x _ @ [ ` { sa".split()
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "Under THE Mit\nLicense", "apache license, version 2.0", "under the mit licenseé", "cc by nc sa", "x" * 100_000 + " cc by nc", "ＭＩＴ under the mit license"]
    texts.append("under the mit license " * 2000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'a' as labels")
    for r in L.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert L.scan(df.limit(0)).collect() == []


def test_every_rule_is_reached_by_its_keywords():
    found, scanner = rules(), L.Scanner(rules())
    assert len(found) >= 200 and len(set((r.label, r.pattern) for r in found)) == len(found)
    for rule, pattern, keywords in scanner.rules:
        sample = re.sub(r"\(\?!(?:[^()]|\(\?:[^()]*\))*\)|\\b", "", rule.pattern).replace(".{0,900}", " ")
        while re.search(r"\([^()]*\)", sample):  # the first choice of each group, none of an optional one
            sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)(\??)", lambda m: "" if m[2] else m[1], sample)
        sample = re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"(\w| )\?", "", sample)).strip()
        text = sample.encode()
        if pattern.search(text):
            assert set(scanner.prefilter.findall(text)) & set(keywords), (rule, sample)
        else:
            raise AssertionError((rule, sample))


def brute(text):
    """(first word, end word, label, score) of every rule's matches, without keywords; the suppression written out."""
    words = lambda at: text.count(" ", 0, at)
    hits = []
    for order, r in enumerate(rules()):
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", text):
            hits.append((-r.priority, m.start() - m.end(), m.start(), order, m.end(), r))
    taken = []
    for _, _, a, _, b, r in sorted(hits, key=lambda h: h[:4]):
        if not any(x <= a and b <= y for x, y, _ in taken):
            taken.append((a, b, r))
    return sorted((words(a), words(b) + 1, r.label, r.score) for a, b, r in taken)


def test_detections_against_brute_force(spark):
    rnd = random.Random(5)
    parts = """the of 0 1 2 3 v2 v3 license licence version mit apache gpl lgpl agpl gnu bsd 3 clause mpl mozilla public spdx identifier
        cc cc0 by nc sa nd 4 creative commons under expat x11 isc eclipse boost software proprietary commercial all rights reserved domain
        general lesser affero or later only unlicense zlib wtfpl artistic""".split()
    phrases = ["under the mit license", "spdx license identifier apache 2 0", "gnu general public license version 3", "all rights reserved", "mit no attribution license", "is in the public domain"]
    texts = [" ".join(rnd.choice(parts if rnd.random() < 0.8 else phrases) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["mit license " * 800, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in L.scan(df, with_detections=True).collect():
        want = brute(" ".join(WORD.findall(texts[r.doc_id] or "")))
        assert sorted((d.start, d.end, d.label, d.score) for d in r.detections) == want, texts[r.doc_id]
        assert set(filter(None, r.labels.split(","))) == {w[2] for w in want} | set(filter(None, r.base_labels.split(",")))
        found += len(want)
    assert found > 1000


def test_a_notice_of_rights_alone_is_weak(spark):
    rows = [(1, "Copyright 2020. All rights reserved."), (2, "Proprietary and confidential. Unauthorized copying is forbidden. All rights reserved.")]
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("proprietary", 0.5) and got[2][1] > 0.95


def test_suppression():
    detect = lambda t: [(a, b, r.label) for a, b, r in L.Scanner(rules()).detect(t.encode())]
    assert detect("licensed under the apache license version 2 0") == [(0, 8, "apache-2")]
    assert detect("the gnu lesser general public license version 2 1 and gnu gpl") == [(1, 9, "lgpl-2.1"), (10, 12, "gpl")]
    assert [x[2] for x in detect("released under the mit license or the gpl version 3")] == ["mit", "gpl-3"]
    assert detect("the permit licenses nothing of note") == []
