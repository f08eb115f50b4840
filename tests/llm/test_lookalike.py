"""Look-alike forms and pairs against the folding of every text."""

from placeloom.llm import lookalike

TEXTS = [
    "12 Main Street", "12 Main Street", "１２ Main Street", "12 Mаin Street", "12 Ma​in Street", " 12  Main Street ", "12 main street", "12 Main St́reet",
    "Zürich", "Zürich", "Zurich", "Москва", "Мocква", "?", "​?", "", " ", None, "​­", "x" * 5000,
]


def test_pairs(spark):
    rows = [(g, i, t, "f") for g in ("name", "q") for i, t in enumerate(TEXTS)] + [("name", 0, TEXTS[0], "f"), (None, 1, "a", "f"), ("name", None, "a", "f"), ("name", 99, TEXTS[0], "f")]
    df = spark.createDataFrame(rows, "field string, key long, text string, form string")
    got = [tuple(x) for x in lookalike.alike_pairs(df, "field", "key", "text", ignore=["?"]).collect()]
    keyed = [(g, k, t) for g, k, t, _ in rows if g and k is not None and t is not None and lookalike.folded(t) not in ("", "?")]
    want = {(g, a, b) for g, a, s in keyed for h, b, t in keyed if g == h and a < b and s != t and lookalike.folded(s) == lookalike.folded(t)}
    assert set(got) == want and len(got) == len(want)


def test_forms(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    forms = {x.text: x.form for x in lookalike.consistent_forms(df).collect()}
    assert {forms[t] for t in TEXTS[:6]} == {"12 Main Street"}
    assert forms["12 main street"] == "12 main street" and forms["Zurich"] == "Zurich"
    assert forms["Zürich"] == forms["Zürich"] == "Zürich"
    assert forms["Мocква"] == forms["Москва"] == "Москва"
    assert forms["​­"] == forms[" "] == "" and len(forms["x" * 5000]) == 5000
    assert lookalike.consistent_forms(df.limit(0)).count() == 0


def test_automaton():
    t = lookalike.Trie()
    for w in ("street", "strait", "st", "Zürich", "lane", "valley"):
        t.add(w, (1,))
    reached = lambda w: [(c, x) for c, _, x in t.near(w)]
    assert reached("stгeet") == [] and reached("stret") == []
    assert reached("strееt") == reached("ｓｔreet") == reached("st\u200b\u00adreet") == reached("ꜱtreet") == [(0, "street")]
    assert reached("Zu\u0308rich") == reached("Ｚürich") == [(0, "Zürich")]
    assert reached("ӏane") == [(0, "lane")] and reached("Ӏane") == [(1, "lane")] and reached("ʋalley") == [(0, "valley")] and reached("υalley") == [(1, "valley")]


def test_vocabulary_decides_where_the_table_cannot(spark):
    """The table reads a palochka as I; only the trie knows that "lane" is a word and "Iane" is none."""
    assert lookalike.folded("Ӏane") == "Iane" and lookalike.folded("ρaypal") == "paypal"
    texts = ["Elm lane", "Elm Ӏane", "Elm Іce", "Elm Ӏce", "Elm Ice"]
    forms = {x.text: x.form for x in lookalike.consistent_forms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert forms == {"Elm lane": "Elm lane", "Elm Ӏane": "Elm lane", "Elm Іce": "Elm Ice", "Elm Ӏce": "Elm Ice", "Elm Ice": "Elm Ice"}
    assert len({lookalike.coarse(t) for t in ("Ӏane", "lane", "Iane")}) == 1
