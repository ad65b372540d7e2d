import random
import re

LONG = "lorem ipsum " * 20_000
#: Null, empty, blank, tiny, odd, repeated and very long texts.
EDGES = [None, "", "   ", "\n", "a", " a ", "a  b", "x▁y", "<|endoftext|> I'm 2 é İ ﬁ́", "\x00\ttab\r\n", "same text here", "same text here", LONG]


def edge_docs(spark, **extra):
    """Documents with ids 0.. (a null id, and one id twice, at the end) and columns of clashing names."""
    rows = [(k, t) for k, t in enumerate(EDGES)] + [(None, "no id"), (1, "second row of one")]
    return spark.createDataFrame([(k, t, "en", 0.5, 7, "x") for k, t in rows], "doc_id bigint, text string, lang string, score double, label int, digest string")


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def shingle_set(text, k):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    """Smallest reachable id of each id; linked: pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_copies(seed, n, words, edits):
    """Copies of one text with up to ``edits`` words replaced."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(words)] = f"e{seed}x{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out
