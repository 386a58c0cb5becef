"""Small plain versions that the operators are compared with."""

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower_ascii(text):
    return text.translate(_LOWER)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(nodes, links):
    """Smallest node of each node's component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
