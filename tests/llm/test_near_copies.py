import random

from strandframe.llm import simhash

from . import brute


def shingles(text, size=5):
    w = brute.lower(text).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def kept(docs, fifths=4):
    """The smallest id of each group of documents whose shingles have a Jaccard similarity of 0.8 or more."""
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= fifths * len(sets[a] | sets[b])]
    for _ in docs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {d for d in root if root[d] == d}, pairs


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def test_recall_against_brute_force(spark):
    rnd = random.Random(11)
    docs = []
    for _ in range(25):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(30, 300))] + "one line that very many of the texts end with".split()
        docs += [edited(rnd, words, n) for n in (0, 0, *(rnd.randrange(1 + len(words) // 30) for _ in range(6)))]
    docs += ["", " ", "a", "A", "a b c", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h x i"]
    docs = list(enumerate(docs))
    want, pairs = kept(docs)
    fp = {d: brute.simhash(t) for d, t in docs}
    assert sum(bin(fp[a] ^ fp[b]).count("1") > 4 for a, b in pairs) > 100  # pairs that four bits of 64 miss
    got = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, edited(rnd, words, 3)) for i in range(300)] + [(1000 + i, " ".join(f"o{i}x{j}" for j in range(50))) for i in range(5)]
    got = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == kept(docs)[0]
