import re

from zonewatch.llm.near_dup import Similarity, keep_first, near_duplicates
from tests.llm.cases import AWKWARD, documents, near_copies, prose


def brute(rows, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    label = {}
    for k, (i, s) in enumerate(sets):
        label[k] = {k}
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is None or sets[b][0] is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y) and label[a] is not label[b]:
                both = label[a] | label[b]
                for k in both:
                    label[k] = both
    out = []
    for k, (i, s) in enumerate(sets):
        c = None if i is None else min(sets[j][0] for j in label[k])
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_against_brute_force(spark):
    texts = AWKWARD + prose(60) + near_copies(120) + near_copies(40, 7, (0, 30)) + prose(20, 5, 5, 12) + prose(10, 5, 5, 12) + AWKWARD
    df = documents(spark, texts)
    for words, percent in ((3, 85), (5, 80)):
        near = Similarity(words=words, percent=percent, block_nodes=16, block_shingles=3000)
        want = brute(list(enumerate(texts)), words, percent)
        assert got(near_duplicates(df, near)) == want
        assert got(near_duplicates(df, Similarity(words=words, percent=percent))) == want


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "same words in here now"), (None, "same words in here now"), (4, "same words in here now"), (4, "same words in here now"),
            (3, "same words in here now"), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df)) == brute(rows, 5, 80)
    kept = sorted(map(tuple, keep_first(df).collect()), key=repr)
    assert kept == sorted([(3, rows[0][1]), (9, None), rows[0], rows[0]], key=repr)


def test_empty_table(spark):
    df = documents(spark, [None]).where("false")
    assert near_duplicates(df).count() == 0
    assert keep_first(df).columns == df.columns


def test_one_id_with_several_texts(spark):
    """A near duplicate goes even if its id also has another text; rows of one group that share an id leave one."""
    a, b = prose(2, 31, 80, 80)
    near = a + " and more"
    rows = [(1, a, "x"), (5, near, "x"), (5, b, "x"), (7, b + " too", "y"), (5, b + " also", "z"), (8, "", "e"), (8, " ", "e"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep__ string")
    kept = sorted(map(tuple, keep_first(df).collect()), key=repr)
    assert [r for r in kept if r[0] != 5] == sorted([(1, a, "x"), (8, "", "e"), (8, " ", "e")], key=repr)
    assert [r[0] for r in kept].count(5) == 1 and all(r[1].startswith(b) for r in kept if r[0] == 5)


def test_clashing_names(spark):
    names = ["id__", "salt__", "turn__", "keep__", "own", "id", "mark", "group", "least", "turn", "component", "name", "row"]
    df = spark.createDataFrame([(1, "some words are here", *names), (2, "some words are here", *names)], ["doc_id", "text", *names])
    assert [tuple(r) for r in keep_first(df).collect()] == [(1, "some words are here", *names)]


def test_long_near_copies(spark):
    """Sets larger than a block are paired one by one, and no set is copied more often than there are sets."""
    base = prose(1, 41, 60_000, 60_000)[0].split()
    texts = [" ".join(base[:k] + ["changed"] + base[k:]) for k in range(0, 60_000, 12_000)] + prose(3, 42, 50_000, 50_000)
    near = Similarity(block_shingles=1000)
    rows = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts), near).collect()}
    assert [rows[k] for k in range(8)] == [0] * 5 + [5, 6, 7]
