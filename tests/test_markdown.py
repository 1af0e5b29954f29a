"""Markdown rules and merges."""

from pyspark.sql import functions as F

from selvage.functions import markdown as M
from selvage.operators import matching as X


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_markdown(spark):
    r = one(spark, M.front_matter, "---\ntitle: 'A b'\n---\nbody")
    assert r.meta == "title: 'A b'" and r.body == "body" and one(spark, M.front_matter, "x\n---\n").meta is None
    assert one(spark, lambda c: M.meta_value(c, "title"), "title: 'A b'\nn: 1") == "A b"
    assert one(spark, M.normal_page, "```md\n# T\n\n\n\nx\n```") == "### T\n\nx"
    assert one(spark, M.balanced_divs, "::: a\nx\n::: b\n:::") == "::: a\nx\n::: b\n:::\n:::"
    assert one(spark, M.div_balance, ":::\nx").stray == 1
    assert one(spark, M.balanced_divs, ":::\nx\n::: a\n:::\n:::") == "x\n::: a\n:::"
    code = "```\n::: a\n:::\n~~~\n:::\n```\n$$\n:::\n$$\n$$ x $$\n::: b"
    assert one(spark, M.balanced_divs, code) == code + "\n:::"
    assert one(spark, M.clean_markdown, "##### a<br>b x<sup>2</sup> <i>c</i>") == "###### a\nb x^2^ c"
    assert one(spark, M.title_fragments, "О $x$ и «у»") == ["О", "и", "у"]
    assert one(spark, lambda c: M.tex_math(c, True), r"\begin{align*}x\label{a}\end{align*}") == r"\begin{aligned}x\end{aligned}"
    r = one(spark, M.theorem_label, "Теорема 1.2 (Гаусса). Пусть x")
    assert (r.type, r.title, r.rest) == ("theorem", "Гаусса", "Пусть x") and one(spark, M.theorem_label, "Просто. Текст") is None
    assert one(spark, M.split_display, "a $$x$$, b") == ["a", "$$x$$,", "b"]
    assert one(spark, M.glossary_terms, "- **Ring** — x\n- Field — y\n- $a$ — z") == ["Ring", "Field"]
    assert [x.text for x in one(spark, M.fixed_lines, "[00:01] a\nb\n[01:02] c")] == ["a b", "c"]
    assert one(spark, M.safe_link, "javascript:x") == "#" and one(spark, M.safe_link, "img/a.png") == "img/a.png"
    assert one(spark, M.local_images, "![a](http://x/y.png)") == "[a](http://x/y.png)"
    assert one(spark, M.plain_math_letters, "𝑘a𝟗") == "ka9"
    assert one(spark, M.despaced, "М А Т Р И Ц А и я") == "МАТРИЦА и я" or one(spark, M.despaced, "М А Т Р И Ц А").replace(" ", "") == "МАТРИЦА"
    assert one(spark, M.plain_text, "## A **b** [c](d)") == "A b c"



def test_div_balance_is_computed_once_a_text(spark):
    """Not once for each line: that made a page cost the square of its lines.  Long texts with and without strays, marks and values."""
    from pyspark.sql import functions as F

    long = "\n".join(f":::\nx{i}\n::: {{.a}}\ny" if i % 50 == 0 else f"line {i}" for i in range(3000))
    df = spark.createDataFrame([(0, long), (1, "a\n\nb"), (2, None), (3, ""), (4, "x ::: y"), (5, "::: a\n:::\n")], "i int, c string").select("i", M.balanced_divs(F.col("c")).alias("c"))
    kept, depth = [], 0
    for x in long.split("\n"):
        if x == ":::" and not depth:
            continue
        depth += (x.startswith("::: ")) - (x == ":::")
        kept.append(x)
    want = {0: "\n".join(kept) + "\n:::" * depth, 1: "a\n\nb", 2: None, 3: "", 4: "x ::: y", 5: "::: a\n:::\n"}
    assert {r.i: r.c for r in df.collect()} == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_matching(spark):
    e = spark.createDataFrame([(1, "undefined sequence alpha beta")], "err int, text string")
    p = spark.createDataFrame([(1, "nothing here"), (2, "alpha beta sequence"), (3, "beta alpha sequence")], "par int, text string")
    assert [r.par for r in X.best_overlap(e, p).collect()] == [2, 3]
    log = spark.createDataFrame([(1, "! Undefined control sequence."), (2, "LaTeX Warning: Reference `a' on page 1"), (3, "! Undefined control sequence."), (4, "Missing character: x"), (5, "ok")], "i int, line string")
    assert {(r.kind, r.n) for r in X.log_summary(log).collect()} == {("error", 2), ("undefined", 1), ("missing", 1)}
    lines = ["para one", "<!-- src: S1.b001 -->", "", "para two", "more", "# head", "tail <!-- src: S1.b002 -->"]
    got = X.master_index(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, i int, line string")).orderBy("item").collect()
    assert [(r.text, r.ids) for r in got] == [("para one", ["S1.b001"]), ("para two more", []), ("# head", []), ("tail", ["S1.b002"])]
    ids = lambda *x: spark.createDataFrame([(i, "p") for i in x], "id string, type string")
    r = X.update_plan(ids("a"), ids("a", "b")).first()
    assert (r.new, r.gone, r.possible) == (1, 0, True)
    items = spark.createDataFrame([("i1", 1, "h1", None), ("i2", 2, "h2", "u"), ("i3", 3, "h2", None), ("i4", 4, "h9", None)], "item string, seq int, sha256 string, url_key string")
    src = spark.createDataFrame([("h1", None)], "sha256 string, url_key string")
    assert {r.item: r.action for r in X.ingest_plan(items, src).collect()} == {"i1": "duplicate", "i2": "add", "i3": "repeat", "i4": "add"}
    cells = spark.createDataFrame([("k", i, m) for i, m in enumerate([0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.9, 0.9, 0.0])], "k string, n int, m double")
    r = X.heaviest_run(cells, "k", "n", "m").first()
    assert (r["first"], r["last"]) == (6, 7)


def test_best_overlap_makes_no_row_of_a_pair_that_only_shares_a_word(spark, monkeypatch):
    """Against the plain counts, over several shards and slices; ties, nulls, equal ids; no join on words."""
    import re

    words = ["the", "and", "éé1", "naïve", "ab", "x_y", "ring", "field", "group", "lemma"]
    text = lambda i, n: " ".join(words[(i * 7 + k * k) % len(words)] for k in range(n))
    errors = [(f"e{i}", text(i, 3 + i % 4)) for i in range(23)] + [("n", None), ("s", "a b"), (None, "the ring"), ("e1", "Lemma THE lemma")]
    pars = [(f"p{i:02d}", text(i + 3, 2 + i % 6)) for i in range(40)] + [("q", None), (None, "the and ring field"), ("p01", "the lemma ring x_y"), ("z", "")]
    tok = lambda s: set(re.findall(r"\w{3,}", (s or "").lower()))
    of = {}
    for e, s in errors:
        of.setdefault(e, []).extend(tok(s))
    want = {}
    for e, toks in of.items():
        if e is not None and toks:
            best = {}
            for p, s in pars:
                k = sum(t in tok(s) for t in toks)
                if k >= 2 and k / len(toks) >= 0.4:
                    best[p] = max(best.get(p, 0), k / len(toks))
            want |= {(e, p): x for p, x in sorted(best.items(), key=lambda b: (-b[1], b[0] is not None, b[0]))[:2]}
    monkeypatch.setattr(X, "ERRORS", 5, raising=False)
    monkeypatch.setattr(X, "PAIRS", 30, raising=False)
    got = X.best_overlap(spark.createDataFrame(errors, "err string, text string"), spark.createDataFrame(pars, "par string, text string").repartition(3))
    assert {(r.err, r.par): r.score for r in got.collect()} == want and len(want) > 20
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
