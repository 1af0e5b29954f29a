"""Operators 2 and 7, their exchange and the components against brute force, on awkward rows."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from selvage.llm import decontaminate, graph, near_dup, substring_dedup
from selvage.llm.kernel import Words
from selvage.session import cut

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string, lang string"


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def awkward():
    """Nulls, blanks, short and long texts, near and exact copies, ties, repeated rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One\ttwo"), (6, "a b c d e"), (None, "a b c d E"), (7, "é ß \u00a0x " * 30)]
    for i in range(8, 30):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    shared = " ".join(rng.choice(words) for _ in range(40))
    for i in range(30, 45):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + " " + shared + "\n" + " ".join(rng.choice(words) for _ in range(20))))
    rows += [(45, "long " * 5000), (46, rows[10][1].upper()), (9, rows[9][1]), (9, rows[9][1])]
    return [(i, t, "xx") for i, t in rows]


def shingles(t):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark):
    rows = awkward()
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_spans(spark):
    rows = awkward()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, (rows[i][1] or "").encode()))
    seen, want = set(), Counter()
    for i in order:
        w = WORD.findall(rows[i][1] or "")
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[rows[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    docs = spark.createDataFrame(rows, DOCS)
    got = substring_dedup.repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    cut = substring_dedup.deduplicated(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    again = Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in cut.collect())
    assert again == Counter({(d, h): 0 for d, _, _, h in want}) + sum((Counter({(d, h): n}) for (d, _, _, h), n in want.items()), Counter())
    untouched = {r.doc_id: r.text for r in cut.collect()}
    assert untouched[1] is None and untouched[3] == " \t\n"
    assert substring_dedup.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "a b", "x", 1, "k"), (2, "a b", "y", 2, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bucket string, part int, data string")
    assert sorted(r.bucket for r in substring_dedup.deduplicated(docs).collect()) == ["x", "y"]
    assert {r.component_id for r in near_dup.near_duplicates(docs).collect()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\réB\u00a0.", max_size=40)), max_size=6))
def test_words(texts):
    w = Words(texts)
    got = [[w.word(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [x for t in got for x in t]
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert len({(h, x) for h, x in zip(w.hash.tolist(), flat, strict=True)}) == len(set(flat))


def test_long_word_and_grams():
    w = Words(["x" * 700_000 + " y", "x" * 700_000 + " y"])
    assert w.hash[0] == w.hash[2] and w.hash[0] != w.hash[1]
    g, ok = w.grams(2)
    assert ok.tolist() == [True, False, True] and g[0] == g[2]


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {"chain": [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]}[kind]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    got = graph.components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.comp, set()).add(r.node)
    want = {}
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize(("whole", "most"), [(graph.WHOLE, 2), (500, 30), (0, 60)])
def test_components_finish_in_one_task(spark, monkeypatch, whole, most):
    """A star, a chain and pairs of binary nodes: the same components however few edges one task joins, and no round for few edges."""
    node = lambda k: k.to_bytes(3, "big")
    edges = [(node(0), node(i)) for i in range(1, 1500)] + [(node(2000 + i), node(2001 + i)) for i in range(200)] + [(node(4000 + 2 * i), node(4001 + 2 * i)) for i in range(100)]
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    got = graph.components(spark.createDataFrame(edges, "a binary, b binary"), whole=whole).collect()
    groups = {}
    for r in got:
        groups.setdefault(bytes(r.comp), set()).add(bytes(r.node))
    want = [{node(i) for i in range(1500)}, {node(2000 + i) for i in range(201)}, *({node(4000 + 2 * i), node(4001 + 2 * i)} for i in range(100))]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want)) and len(got) == 1901
    assert all(c in g for c, g in groups.items()) and len(written) <= most


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Near copies of one text: their links are joined by one task, twice, not by rounds of jobs."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:59], f"end{i}"])) for i in range(40)]
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 40
    assert written == ["edges", "hop"] * 2


def _brute(docs, items, threshold, overlap):
    """Every passage of every document scored in full against every item; an item's passages follow from its length alone."""
    words = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", low(t), re.ASCII)
    w = [words(t or "") for _, t in items]
    n, mean = len(w), max(sum(map(len, w)) / max(len(w), 1), 1)
    df = Counter(x for t in w for x in set(t))
    idf = {x: np.log(1 + (n - c + 0.5) / (c + 0.5)) for x, c in df.items()}
    imp = []
    for t in w:
        tf = Counter(t)
        raw = {x: idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x, c in tf.items()}
        imp.append({x: v / sum(raw.values()) for x, v in raw.items()})
    grams = lambda t: {tuple(t[i : i + min(3, len(t))]) for i in range(len(t) - min(3, len(t)) + 1)} if t else set()
    out = set()
    for d, text in docs:
        t = words(text or "")
        for (i, _), v, wi in zip(items, imp, w, strict=True):
            step = 16
            while step < len(wi):
                step *= 2
            for at in range(0, max(len(t) - step, 1), step):
                p = t[at : at + 2 * step]
                if not wi or sum(v.get(x, 0) for x in set(p)) < threshold - 1e-9:
                    continue
                have = {tuple(p[j : j + k]) for k in (1, 2, 3) for j in range(len(p) - k + 1)}
                c = decontaminate.split(len(wi))
                parts = [grams(wi[:c]), grams(wi[c:])]
                if all(not g or len(g & have) / len(g) >= overlap for g in parts):
                    out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(4, 40))) for i in range(20)] + [(90, None), (91, "..."), (92, "single"), (3, "twice the same id")]
    docs = [(i, say(rng.randint(0, 200))) for i in range(60)] + [(100, None), (101, "")]
    for i in range(20):
        w = items[i][1].split()
        docs.append((200 + i, say(30) + " " + items[i][1].upper().replace(" ", ", ") + "! " + say(50)))
        docs.append((300 + i, say(30) + " " + " ".join(w[: len(w) // 2]) + " " + say(50)))
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(D, I).collect()}
    assert got == _brute(docs, items, 0.5, 0.5)
    assert {(200 + i, i) for i in range(20)} <= got
    kept = {r.doc_id for r in decontaminate.clean(D, I).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.leaks(D, I.limit(0)).count() == 0 and decontaminate.leaks(D.limit(0), I).count() == 0


def test_leaks_do_not_depend_on_other_items(spark):
    """A question and its answer 300 words apart are no leak, whatever other items there are; a whole item is one wherever it stands."""
    rng = random.Random(5)
    say = lambda n, v="v": [f"{v}{rng.randrange(4000)}" for _ in range(n)]
    item, long = say(30, "q"), say(500, "z")
    apart = item[:20] + say(300) + item[20:]
    docs = [(1, " ".join(apart)), (2, " ".join(long)), *((10 + k, " ".join(say(k) + item + say(70))) for k in range(0, 80, 3))]
    D = spark.createDataFrame(docs, "doc_id bigint, text string")
    for others in ([], [(2, " ".join(long))], [(9, " ".join(say(1500, "y")))]):
        found = decontaminate.leaks(D, spark.createDataFrame([(1, " ".join(item)), *others], "item_id bigint, text string")).collect()
        assert {r.doc_id for r in found if r.item_id == 1} == {d for d, _ in docs[2:]}


def test_leaks_shards(spark, monkeypatch):
    """Shards and passes do not change what is found; blocks are skipped, not items; memory follows postings."""
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 7)
    monkeypatch.setattr(decontaminate, "GROUP", 2)
    rng = random.Random(6)
    say = lambda n: " ".join(f"v{rng.randrange(50)}" for _ in range(n))
    items = [(i, say(rng.randint(2, 60))) for i in range(40)]
    docs = [(i, say(rng.randint(0, 80)) + " " + items[i % 40][1] + " " + say(9)) for i in range(60)]
    cols = spark.createDataFrame([(*d, "x", 1.0, 2) for d in docs], "doc_id bigint, text string, item_id string, score double, start int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(cols, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == _brute(docs, items, 0.5, 0.5)
    kept = decontaminate.clean(cols, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == cols.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_search_sorts(spark, monkeypatch):
    """Searching takes distinct numbers by sorting: numpy's hash table and membership test took a third of its time."""
    rng = random.Random(5)
    items = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (1, 9, 16, 17, 40)]
    texts = [None, "", items[0], *(f"{' '.join(f'v{rng.randrange(50)}' for _ in range(rng.randrange(90)))} {x} end" for x in items), " ".join(items)]
    words = [x for i in items for x in set(decontaminate.Words([i], fold=True).hash.tolist())]
    ix = decontaminate.build(list(range(5)), items, {x: 1.0 for x in words}, 17.0, 0.5)
    unique = np.unique

    def rows_only(x, axis=None, **more):
        assert axis == 0 or sys._getframe(1).f_globals["__name__"] != decontaminate.__name__
        return unique(x, axis=axis, **more)

    monkeypatch.setattr(np, "unique", rows_only)
    got = {(d, k) for d, k, *_ in decontaminate.search(ix, decontaminate.Words(texts, fold=True), 0.5, 0.5)}
    assert got >= {(3 + k, k) for k in range(5)} | {(8, k) for k in range(5)} and not {d for d, _ in got} & {0, 1}
    odd = np.array([5, 1, 5, 3], np.int64)
    assert decontaminate._unique(odd).tolist() == [1, 3, 5] and decontaminate._unique(odd[:0]).tolist() == []
    for limit in (decontaminate._TABLE, 0):
        monkeypatch.setattr(decontaminate, "_TABLE", limit)
        assert decontaminate._places(odd, np.array([1, 5])).tolist() == [1, 0, 1, -1] and decontaminate._places(odd, odd[:0]).tolist() == [-1] * 4
        assert decontaminate._places(odd[:0], np.array([9])).tolist() == []
    assert decontaminate._rows_with(odd, np.array([3])).tolist() == [False, False, False, True] and len(decontaminate._rows_with(odd[:0], odd[:0])) == 0
