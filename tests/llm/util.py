"""Helpers of the tests of the training-data operators."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, source="s"):
    """documents rows with ids from 0, or the given (doc_id, text) pairs."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in rows], DOCS)


def groups(pairs, nodes):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}
