"""Operators 3, 4, 5, 6, 8, 9, 10 against plain models, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from selvage.llm import chat, classifier, exchange, kernel, mixing, quality_rules, suffix_tree, token_counts, url_filter
from selvage.llm import queries as Q
from selvage.llm.tokenizer import encoding
from selvage.tables import table

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string"


def rows():
    rng = random.Random(8)
    words = ["the", "of", "a", "to", *(f"w{i}" for i in range(60))]
    out = [(1, None, "a"), (2, "", None), (3, "  \n", "b"), (None, "the the the the", "b"), (4, "the " * 3000, "a")]
    for i in range(5, 70):
        out.append((i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))), rng.choice(["a", "b", "é", None])))
    return out + [out[9], out[9], (70, out[10][1], "c")]


def _suffix_tree(data, depth):
    """The tree as dictionaries, level by level, and each row's result."""
    T = suffix_tree
    docs = [(i, [*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None]) for i, t, _ in data]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [w for i, w in docs if not held(i)]
    count = [Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(depth + 2)]
    n, v = sum(count[1].values()), len(count[1])
    base = lambda x: (count[1][x,] + 1) / (n + v + 1)
    mass, tested, states = {}, {()}, {()}

    def prob(context, x):
        """In the state of the longest retained suffix."""
        if not context:
            return base(x)
        if context not in states:
            return prob(context[1:], x)
        m = mass[context]
        return (count[len(context) + 1][*context, x] + m * prob(context[1:], x)) / (count[len(context)][context] + m)

    sizes = []
    for k in range(1, depth + 1):
        level = [c for c, z in count[k].items() if z >= T.LEAST and c[1:] in states and c[:-1] in tested and None not in c]
        follow = defaultdict(list)
        for g, z in count[k + 1].items():
            follow[g[:-1]].append((g[-1], z))
        for c in level:
            z = count[k][c]
            of = lambda x, y, m, c=c, z=z: y * (math.log((y - 1 + m * prob(c[1:], x)) / ((z - 1 + m) * prob(c[1:], x))) - T.RATIO)
            # followers that occur twice or more are sent in steps (these texts are one bucket)
            gain = [round(sum(of(x, y, m) for x, y in follow[c] if y > 1) * T.STEPS) / T.STEPS + sum(of(x, y, m) for x, y in follow[c] if y == 1) for m in T.MASSES]
            assert abs(max(gain) - T.GAIN) > 1e-4
            if max(gain) > T.GAIN:
                mass[c] = T.MASSES[gain.index(max(gain))]
        tested |= set(level)
        states |= {c for c in level if c in mass}
        sizes.append(sum(c in mass for c in level))
    out = []
    for i, w in docs:
        total = 0.0
        for k, x in enumerate(w):
            c = ()
            while len(c) < min(k, depth) and (longer := tuple(w[k - len(c) - 1 : k])) in states:
                c = longer
            total += math.log10(prob(c, x))
        out.append((i or -1, held(i), len(w), sum(count[1][x,] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), total))
    return out, sizes


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_suffix_tree(spark, depth):
    rng = random.Random(3)
    said = " ".join(f"w{rng.randrange(60)}" for _ in range(40))
    data = rows() + [(100 + i, f"{said if i % 3 else said.replace('w1', 'w2')} w{i % 5} w{i % 7}", "a") for i in range(30)]
    want, sizes = _suffix_tree(data, depth)
    assert all(sizes[: min(depth, 3)])  # contexts of several lengths pass
    got = suffix_tree.scored(spark.createDataFrame(data, DOCS), depth=depth).collect()
    key = lambda r: (*r[:5], round(r[5], 4), round(r[6], 3))
    for g, w in zip(sorted(((r.doc_id or -1, *r[1:]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-4 * max(1, abs(w[6]))


def test_suffix_tree_edges(spark):
    assert suffix_tree.scored(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a b a b", 5, "x")], "doc_id bigint, text string, bucket int, data string")
    assert [r.n_tokens for r in suffix_tree.scored(odd).collect()] == [5]
    with pytest.raises(TypeError):
        suffix_tree.scored(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_suffix_tree_tells_grams_apart(spark):
    """Two pairs whose words' hashes share the range (of four) and the low half: a rare one must not take the counts of a frequent one."""
    a, b, c, d = "w85588", "w85589", "w713449", "w713450"

    def scores(last):
        data = [(i, f"{a} {b}", None) for i in range(60)] + [(60 + i, f"{c} x{i % 3} {last}", None) for i in range(20)] + [(80 + i, f"{c} {last}", None) for i in range(4)]
        return {r.doc_id: (round(r.base_score, 9), round(r.score, 6)) for r in suffix_tree.scored(spark.createDataFrame(data, DOCS)).collect()}

    assert scores(d) == scores("other")  # a name does not matter


def test_suffix_tree_over_buckets(spark, monkeypatch):
    """Dealt to many buckets and ranges, texts score as in one; only steps of the tests' shares may differ."""
    docs = table(spark, SF, "documents")
    one = {r.doc_id: r for r in suffix_tree.scored(docs).collect()}
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 40_000)
    assert exchange.widths(docs, "text") > 4
    many = {r.doc_id: r for r in suffix_tree.scored(docs).collect()}
    assert set(one) == set(many)
    for i, a in one.items():
        assert a[1:5] == many[i][1:5] and abs(a.base_score - many[i].base_score) < 1e-6
    assert abs(sum(r.score for r in one.values()) / sum(r.score for r in many.values()) - 1) < 1e-3


def test_distinct_numbers():
    """As numpy's, also where keys differ only in the bits that the sort leaves out, and of none."""
    rng = np.random.default_rng(4)
    near = (rng.integers(0, 1 << 40, 300, dtype=np.uint64) << np.uint64(24))[rng.integers(0, 300, 5000)] + rng.integers(0, 3, 5000).astype(np.uint64)
    for keys in (near, near | np.uint64(1 << 63), near[:1], near[:0], np.zeros(9, np.uint64), rng.integers(0, 50, 999).astype(np.uint32), rng.integers(0, 1 << 32, 999).astype(np.uint32)):
        want = np.unique(keys, return_inverse=True, return_counts=True)
        for x, y in zip(kernel.distinct(keys), want, strict=True):
            assert x.tolist() == y.tolist()
        assert kernel.numbers(keys).tolist() == want[1].tolist() and kernel.distinct(keys)[0].dtype == keys.dtype


def test_coded_runs():
    """Pieces of any widths come back, whatever the signs, and empty planes take no room."""
    top = np.iinfo(np.int64)
    cols = [np.array([0, 1, 2**40, 5, 2**64 - 1, 7], np.uint64), np.array([0, -1, 1, top.min, top.max, -300], np.int64), np.array([1, 0, 255, 256, 70000, 3], np.uint32), np.array([0, 1.5, -2, np.inf, 0, 9], np.float32)]
    kinds = [c.dtype for c in cols]
    data = exchange.coded_runs(cols, [0, 2, 2, 5, 6]) + exchange.coded_runs([c[:2] for c in cols], [0, 2])
    got, ends = exchange.decoded_runs(data, kinds)
    assert ends.tolist() == [0, 2, 2, 5, 6, 8]
    for c, g in zip(cols, got, strict=True):
        assert g.dtype == c.dtype and g.tolist() == [*c.tolist(), *c[:2].tolist()]
    assert [x.tolist() for x in exchange.decoded_runs([], kinds)[0]] == [[]] * 4
    assert exchange._planes([np.arange(9)])[0] == b"\x01" and exchange._planes([np.array([-200])])[0] == b"\x02"


def test_suffix_tree_levels_send_to_few_ranges(spark, monkeypatch):
    """Where few tokens are left, buckets send to few ranges: each row between a bucket and a range has its own cost."""
    docs = table(spark, SF, "documents")
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_tree, "LEAST_RANGES", 2, raising=False)
    rows, cut = [], suffix_tree.cut
    monkeypatch.setattr(suffix_tree, "cut", lambda df, name: (out := cut(df, name), rows.append(out.select("part").distinct().count()) if name == "grams" else None)[0])
    suffix_tree.scored(docs)
    assert len(rows) > 2 and rows[-1] < rows[0] // 2


def test_suffix_tree_beats_base_on_held_out(spark):
    r = suffix_tree.scored(table(spark, SF, "documents")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_measures(spark):
    data = rows()
    want = Counter()
    for i, t, _ in data:
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(again)] += 1
    got = quality_rules.measures(spark.createDataFrame(data, DOCS)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


@pytest.mark.parametrize("n_keys", [1, 2, 7])
def test_measures_with_equal_keys(spark, monkeypatch, n_keys):
    """Unequal windows that share a key, also between equal ones, change no count."""
    rng = random.Random(n_keys)
    texts = [" ".join(rng.choices("abc", k=n)) for n in (0, 1, 2, 3, 4, 5, 9, 20, 40)] + ["a b c x y a b c", "a a a a", "p q r s t u v w"]
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        want[i] = len({k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)})
    whole = quality_rules._window_key
    monkeypatch.setattr(quality_rules, "_window_key", lambda *w: F.pmod(whole(*w), F.lit(n_keys)))
    got = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == want


def test_weak_supervision(spark):
    """EM recovers planted accuracies; the native posterior is the model's; labels agree."""
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.9
    votes = [tuple(int(v) for v in np.where(rng.random(5) < 0.1, 0, np.where(g, np.where(rng.random(5) < 0.005, -1, 1), np.where(rng.random(5) < 0.7, -1, 1)))) for g in good]
    share, probs = quality_rules.estimate(Counter(votes))
    assert abs(share - 0.9) < 0.03
    assert np.mean([(quality_rules.posterior(v, share, probs) > 0.5) == g for v, g in zip(votes, good, strict=True)]) > 0.97
    assert quality_rules.estimate({})[0] == 0.9
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = quality_rules.judged(docs)
    names = quality_rules.rules()
    found = out.select("doc_id", "base_failed", "p_good", "kept", *(c.alias(k) for k, c in names.items())).collect()
    share, probs = quality_rules.estimate(Counter(tuple(r[k] for k in names) for r in found))
    for r in found:
        p = quality_rules.posterior([r[k] for k in names], share, probs)
        assert abs(p - r.p_good) < 1e-6 and r.kept == (not r.base_failed and r.p_good >= 0.5)
    label = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    fine = [r.kept for r in found if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(fine) / len(fine) > 0.97
    assert quality_rules.judged(spark.createDataFrame([], DOCS)).count() == 0


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        share = sum(weight[s] for s in free)
        left = total - sum(target.values())
        over = {s for s in free if left * weight[s] / share > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / share for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark):
    data = rows()
    docs, none = spark.createDataFrame(data, DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = mixing.mixed(mixing.sized_documents(docs, none)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += size(t)
    want = _targets(sizes)
    assert len(got) == len(data)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.repeats * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(size(x) for _, x, y in data if y == s) / 2 + 1
    again = mixing.mixed(mixing.sized_documents(docs.repartition(7), none)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    assert mixing.mixed(mixing.sized_documents(docs.limit(0), none)).count() == 0


def test_mixing_odd_columns(spark):
    """Clashing names, missing and extra columns, nulls, repeated rows, no weight."""
    data = [(1, "a b c", "s", 5, 1, 2.0, "r", "x"), (1, "a b c", "s", 5, 1, 2.0, "r", "x"), (None, "d e", None, 5, 1, 2.0, "r", "x"), (2, None, "s", 5, 1, 2.0, "r", "x"), (3, "f " * 9000, "s", 5, 1, 2.0, "r", "x")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, rows int, epochs int, rest double, target string, quality string")
    labels = spark.createDataFrame([(3, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = mixing.mixed_documents(docs, labels).collect()
    assert {r.rest for r in got} == {2.0} and {r.quality for r in got} == {"x"} and sum(r.doc_id == 1 for r in got) <= 2
    assert all(r.taken == r["size"] * r.repeats and r["size"] == len((r.text or "").split()) for r in got)
    sized = docs.select("*", F.lit(3).cast("long").alias("size")).drop("quality").withColumn("quality", F.lit(0.0))
    out = mixing.mixed(sized)
    assert out.count() == 5 and {"rows", "epochs", "rest"} <= set(out.columns)
    assert mixing.mixed_documents(docs.limit(0), labels).count() == 0


def test_mix_plans_targets_once(spark):
    """The sums and the rows of the prefix sum read written targets: only its own two windows are left in the plan."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = mixing.mixed(mixing.sized_documents(docs, table(spark, "/root/testdata/sf0.001", "labels")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 2


def test_heavier_documents_come_first(spark):
    data = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"))
    r = {x.k: x.n for x in mixing.mixed(data, (1, 3), 3).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("k")).agg(F.sum("repeats").alias("n")).collect()}
    assert r[0] > 2 * r[1] and abs(r[0] + r[1] - 1000) <= 1


def test_urls(spark):
    page = lambda u, canonical="": f'<link href="{canonical}" rel="canonical">' if canonical else ""
    data = [
        (1, "https://a.net/es/x", ""), (2, "https://b.org/p#f", page("", "https://a.net/es/x")), (3, "http://c.org/q", page("", "http://b.org/p")), (4, "https://d.org/", page("", "https://ok.com/")),
        (5, None, ""), (6, "no scheme", ""), (7, "http://EXAMPLE.com/en/1", ""), (8, "http://www.example.com/en/1", ""), (9, "http://notexample.com/en/", ""), (10, "http://e.org/z", '<meta http-equiv="refresh" content="0; url=/p"/>'),
        (11, "https://mixed.org/", page("", "https://a.net/fr/1")), (12, "https://mixed2.org/", page("", "https://mixed.org/")), (13, "https://x.com/", page("", "https://mixed.org/")), (14, "http://net/es", ""), (14, "http://net/es", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(data, "page_id bigint, url string, html string"), Q.URL_RULES).collect()}
    assert got[1] == ("a.net", "/es/x", "net/es/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")  # aliases of a blocked page
    assert got[4][3] == "allow" and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("example.com", "/en/1", "example.com/en/", "block") and got[8][2:] == ("www.example.com/en/", "allow") and got[9][2:] == ("com/", "allow")
    assert got[11][3] == got[12][3] == "allow" and got[13][2:] == ("com/", "allow")  # an allowed alias outranks a blocked one
    assert got[14] == ("net", "/es", None, "allow")
    urls = spark.createDataFrame([(i, u) for i, u, _ in data], "k bigint, url string").select("k", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"))
    table_ = spark.createDataFrame([(r, v) for v, r in Q.URL_RULES], "rule string, verdict string")
    assert {r.k: r.rule for r in url_filter.by_table(urls, table_, "k").collect()} == {k: v[2] for k, v in got.items() if v[2]}


def test_relative_targets(spark):
    """Targets as urllib resolves them, attributes in either order, entities decoded."""
    from urllib.parse import urljoin

    urls = ["http://h.org/a/b/c.html?q=1", "https://h.org/a/", "http://h.org"]
    targets = ["page2.html", "../en/", "?id=1&x=2", "index.html", "./x/./y", "../../../z?u=http://o.org/", "..", "/r/../s", "//o.org/t", "https://o.org/u?v=1#w", "x/y/.."]
    metas = ['<link rel=canonical href="{}">', '<link href="{}" rel="canonical">', '<meta http-equiv="refresh" content="0; url={}">', '<meta content="0; url={}" http-equiv=refresh>']
    data = [(u, m.format(t.replace("&", "&amp;")), t) for u in urls for t in targets for m in metas]
    got = url_filter.page_edges(spark.createDataFrame(data, "url string, html string, t string")).collect()
    bare = lambda x: x.split("#")[0].split("://", 1)[1]
    want = {(bare(u), bare(urljoin(u, t))) for u, _, t in data if bare(u) != bare(urljoin(u, t))}
    assert {(r.a, r.b) for r in got} == want
    assert len(got) == sum(bare(u) != bare(urljoin(u, t)) for u, _, t in data)
    other = [("http://h.org/a", f'<link rel=canonical href="{t}">') for t in ("mailto:a@b.org", "javascript:x", "#top")]
    assert url_filter.page_edges(spark.createDataFrame([*other, ("no scheme", data[0][1])], "url string, html string")).count() == 0
    rows_ = [(1, "http://a.net/es/x", ""), (2, "http://a.net/q/p", '<meta content="0; url=../es/x" http-equiv=refresh>')]
    assert {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows_, "page_id bigint, url string, html string"), Q.URL_RULES).collect()} == {1: "block", 2: "block"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\-<>|/s[]INTturnsepd SY_im\n"), max_size=30))
def test_escape(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|turn|>user<|sep|>", "\\-<\\/s>", "<<SYS>><</SYS>>"])
def test_escape_control(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


def test_chat(spark):
    data = [(1, 0, "user", "hi é 🙂"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "<|turn|>x\\"), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "a\tb"), (3, 1, "assistant", "z " * 20000)]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = defaultdict(list)
    for c, _, r, t in sorted(data, key=lambda x: (x[0] or -1, x[1] or -1, x[2] or "", x[3] or "")):
        by[c].append((r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[c].formatted_chars == sum(len(chat.escape(r)) + len(chat.escape(t)) + sum(map(len, chat.PRINTED.values())) for r, t in turns)
    assert chat.digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_chat_twin(spark):
    """The SQL twin on control strings of every kind, backslashes, nulls, ties and repeats."""
    kinds = [*chat.CONTROL, "<<s>", "\\</s>", "[[INST]\\\\", "<</SYS>><|end|", "é🙂\n", "", None]
    data = [(c, t, role, f"{a}x{b}" if a is not None and b else a) for c, role in ((1, "user"), (2, "assistant"), (3, "<s>"), (4, None)) for t, (a, b) in enumerate(zip(kinds, kinds[3:] + kinds[:3], strict=True))]
    data += [(5, None, "assistant", "b"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (None, 0, "user", "u"), (-1, 0, "user", Q.CONTROL_TEXT), (-1, 1, "assistant", Q.CONTROL_TEXT)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in data if r[0] != -1])
    want = con.execute(Q.ORACLES["op8_chat_format"])
    names = [d[0] for d in want.description]
    got = chat.digests(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(want.fetchall(), key=repr)


def test_token_counts(spark):
    data = rows()
    enc = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    n = [len(enc.encode_ordinary(t or "")) for _, t, _ in data]
    hist = token_counts.histogram(spark.createDataFrame(data, DOCS))
    got = {r.n_tokens: r for r in token_counts.suffix_sums(hist).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.docs_up_to, r.truncated_total) == (sum(x <= k for x in n), sum(min(x, k) for x in n))
    sums = token_counts.suffix_sums(hist)
    assert token_counts.truncated_total(sums, 7).first().total == sum(min(x, 7) for x in n)
    assert token_counts.quantile(sums, 0.5).first().n_tokens == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.histogram(spark.createDataFrame([], DOCS)).count() == 0


def test_classifier_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    learn = labels.where("pmod(xxhash64(doc_id, 1), 5) <> 0")
    model = classifier.trained(docs, learn)
    assert (np.diff(model.theta) >= 0).all()
    got = classifier.rated(docs, model).join(labels.join(learn, "doc_id", "left_anti"), "doc_id").collect()
    clean, junk = [r for r in got if r.quality == 1 and not r.toxic], [r for r in got if r.quality == 0]
    assert np.mean([r.kept for r in clean]) > 0.98 and np.mean([r.kept for r in junk]) < 0.1
    toxic = [r for r in got if r.toxic]
    assert np.mean([r.kept for r in toxic]) < 0.5
    assert np.mean([r.expected_grade for r in clean]) > np.mean([r.expected_grade for r in toxic]) > np.mean([r.expected_grade for r in junk])


def test_fit_is_the_maximum(spark):
    """Against plain penalised maximum likelihood: no small step of any parameter makes the sample likelier."""
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 600)
    rows_ = [np.unique(np.concatenate((rng.integers(0, 40, 5), [50 + g] if rng.random() < 0.7 else [60]))).astype(np.int32) for g in grades]
    m = classifier.fit(rows_, grades, bits=7, steps=3000, rate=0.05, l2=1e-3, z=4.0, power=0.0)

    def loss(weights, theta):
        above = lambda z, g: 1.0 if g < 0 else 0.0 if g >= len(theta) else 1 / (1 + math.exp(theta[g] - z))
        z = [sum(weights[i] for i in r) for r in rows_]
        return -sum(math.log(above(x, g - 1) - above(x, g)) for x, g in zip(z, grades, strict=True)) / len(rows_) + 5e-4 * sum(w * w for w in weights[weights != 0])

    weights, theta = m.weights.astype(float), m.theta
    least, used = loss(weights, theta), np.flatnonzero(weights)
    assert 50 in used and 52 in used and weights[52] > weights[50]
    for i in used:
        for step in (-0.03, 0.03):
            moved = weights.copy()
            moved[i] += step
            assert loss(moved, theta) > least - 1e-6
    for i in range(2):
        for step in (-0.03, 0.03):
            moved = theta.copy()
            moved[i] += step
            assert loss(weights, moved) > least - 1e-6


def test_sample_is_bounded(spark):
    """Documents that repeat a labelled id do not multiply beyond the bound; bytes are bounded too."""
    docs = spark.createDataFrame([(1, f"a b{i}") for i in range(300)] + [(2, "c d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert [len(classifier.sampled(docs, labels, n)[0]) for n in (1, 7, 1000)] == [1, 7, 301]
    whole = classifier.sampled(docs, labels)[0]
    few = classifier.sampled(docs, labels, most_bytes=4 * sum(len(x) for x in whole[:50]))[0]
    assert len(few) == 50 and all((a == b).all() for a, b in zip(few, whole, strict=False))


def test_classifier_edges(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([(5, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = classifier.trained(docs, labels)
    out = classifier.rated(docs, model).collect()
    assert len(out) == len(rows()) and all(r.kept for r in out)
    assert classifier.accepted(docs, model).count() == len(rows())
    a = classifier.fit([np.array([1, 2]), np.array([3])] * 20, np.array([0, 2] * 20))
    assert a.above(a.score([np.array([1, 2]), np.array([3])]))[:, -1].round().tolist() == [0, 1]
