"""Small inputs with awkward rows, and plain versions of what the operators compute."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
#: Names that operators use inside; the input may have them too.
CLASH = "row score label size hash class node id n bucket root held_out taken shard component_id spans found new mark".split()


def awkward(spark, texts=()):
    """Null, empty, blank, very long and repeated texts, null and repeated ids, null columns, clashing extra columns."""
    rows = [(1, "plain text of a few words", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", None),
            (5, LONG, "en", "a"), (6, LONG, "en", "b"), (6, LONG, "en", "b"), (None, "no id here at all", None, None),
            (7, "1234 !!! ###", "xx", "c"), (7, "same id and another text", "xx", "c")]
    rows += [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([r + tuple(f"{c}-{i}" for c in CLASH) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, "
                                 + ", ".join(f"`{c}` string" for c in CLASH))


def no_rows(spark):
    return awkward(spark).limit(0)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, n=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def roots(nodes, links):
    """Smallest node reachable from each."""
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def variants(seed, bases=6, copies=9, size=60):
    """Texts in groups: copies with more and more words changed, and a passage that many of them share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(12))
    out = []
    for _ in range(bases):
        base = [word() for _ in range(rng.randint(6, size))]
        for k in range(copies):
            text = list(base)
            for _ in range(k // 2):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text) + (f" {passage}" if rng.random() < 0.5 else ""))
    return out + [passage, passage.upper(), "a b", "a b", "a"]
