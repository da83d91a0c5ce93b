"""Small inputs that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, label string, __leak long, __toxicity string, __kept long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the last columns clash with names used inside operators."""
    return spark.createDataFrame([(i, t, *(more or ["en"]), "s", len(t or ""), "x", 1, "l", 5, "t", 7) for i, t, *more in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "word " * 20000), (6, "日本語 <|endoftext|> Привет 🙂"), (7, "same text of a few words"), (8, "same text of a few words")]


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
