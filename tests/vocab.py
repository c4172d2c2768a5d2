"""A small vocabulary with the edge cases of the queries."""

from arbolex.sources import store


def rows():
    n, t, k = [], [], []

    def node(code, path=(), children=(), refs=(), base=None, key=None, texts=None):
        n.append((code, code.lower(), list(path), list(children), list(refs), base, key, base is not None))
        for lang, label in (texts or {}).items():
            t.append((code, lang, label, len(t)))

    node("7", texts={"en": "Bible"}, children=["73"])
    node("73", ["7"], ["73D"], texts={"en": "New Testament"})
    node("73D", ["7", "73"], [f"73D{i}" for i in range(1, 10)], ["7", "NOPE"], texts={"en": "Passion of Christ", "de": "Leiden Christi"})
    for i in range(1, 10):
        if i != 4:  # 73D4 is missing
            node(f"73D{i}", ["7", "73", "73D"], texts={"en": f"the angel with trumpet {i}" if i < 3 else f"station {i}", "fr": f"étape {i}"})
    node("73D82(CROSS)", ["7"], texts={"pt": "cruz"})
    node("25F23", children=["25F23(LION)"], texts={"en": "beasts of prey"})
    node("25F23(LION)", ["25F23"], texts={"en": "beasts of prey: lion"})
    for key in ("+1", "+46", "+2"):
        node(f"25F23({key})", ["25F23"], base="25F23", key=key, texts={"en": f"beasts of prey (+ {key})"})
    node("25g%_\\x", texts={"en": "wild"})
    node("11H", children=[f"11H{i:02d}" for i in range(30)], texts={"en": "saints", "nl": "heiligen"})
    for i in range(30):
        node(f"11H{i:02d}", ["11H"], [f"11H{i:02d}{j}" for j in range(12)], texts={"nl": f"heilige {i}"})
        for j in range(12):
            node(f"11H{i:02d}{j}", ["11H", f"11H{i:02d}"])
    t.append(("GHOST", "en", "a ghost label", len(t)))
    for i in range(45):
        k.append(("73D", "en", f"keyword {i}", len(k)))
    k += [("25F23", "de", "Raubtier", len(k)), ("25F23", "fr", "fauve", len(k) + 1), ("7", "en", "scripture", len(k) + 2), ("7", "en", "scripture", len(k) + 3)]
    counts = [("a-cat", "73D", 5), ("b_cat", "73D", 9), ("a-cat", "25F23", 2), ("a-cat", "UNKNOWN", 4), ("a-cat", "73D1", 1)]
    info = [("a-cat", "A Cat", None, 4, "https://a.example/{notation}"), ("b_cat", "B Cat", None, 1, None), ("c", "C", None, 0, None)]
    return n, t, k, counts, info


def vocabulary(spark):
    n, t, k, counts, info = rows()
    s = store.SCHEMAS
    vectors = [(c, [round(x * 127) for x in v]) for c, v in {"7": (1.0, 0.0), "73": (0.6, 0.8), "73D": (0.0, 1.0), "25F23": (-1.0, 0.0)}.items()]
    make = spark.createDataFrame
    return store.vocabulary(
        spark,
        notations=make(n, s["notations"]),
        texts=make(t, s["texts"]),
        keywords=make(k, s["keywords"]),
        counts=make(counts, s["counts"]),
        info=make(info, s["info"]),
        embeddings=make(vectors, s["embeddings"]),
        meta=make([("embedding_dimensions", "2"), ("schema_version", store.SCHEMA_VERSION)], s["meta"]),
    )


def embed(query):
    return [1.0, 0.1] if "bible" in query else [-1.0, 0.0]


