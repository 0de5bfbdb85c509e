"""Small fixtures and brute-force models for the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=1, vocabulary=400, least=1, most=120):
    """Documents with exact copies, near copies, a shared passage, nulls, empty and very long texts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(vocabulary)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.12:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.45:
            old = (rnd.choice(texts) or "").split(" ")
            for _ in range(rnd.randint(1, 3)):
                at = rnd.randrange(len(old) + 1)
                old[at : at + rnd.randint(0, 1)] = [rnd.choice(words)]
            texts.append(" ".join(old))
        else:
            t = " ".join(rnd.choice(words) for _ in range(rnd.randint(least, most)))
            texts.append(f"{t}\n{passage}\n{t[:20]}" if kind > 0.75 else t)
    texts += [None, "", "   \n\t ", "one", "ONE", " ".join(rnd.choice(words) for _ in range(6000))]
    langs, sources = ["en", "de", "fr", None], ["src0", "src0", "src0", "src1", "src7", None]
    return [(i, t, rnd.choice(langs), rnd.choice(sources), len(t or "")) for i, t in enumerate(texts)]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def jaccard_rows(rows, k=5, percent=80):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = classes(ids, links)
    return sorted((i, len(sets[i]), found[i]) for i in ids)
