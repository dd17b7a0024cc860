"""Made-up texts for the corpus operators."""

import random

WORDS = "the of and tion ing er on re at en or ti es an he nd ble ly th".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    """Ids, texts: nulls, empties, copies, near copies, shared passages, a
    long periodic text, other scripts, repeated rows, a null id."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    passage = prose(rng, 40)
    rows = list(enumerate(base))
    rows += [(100 + k, base[k]) for k in range(0, 20, 2)]
    rows += [(200 + k, base[k].replace("the", "ten", 1)) for k in range(0, 30, 3)]
    rows += [(300 + k, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for k in range(12)]
    rows += [(400, None), (401, ""), (402, "   \n\t"), (403, "ab " * 4000), (404, "ab " * 3000 + "end"), (405, "x" * 9000)]
    rows += [(406, "Größe 東京 🙂 naïve " * 12), (407, "Größe 東京 🙂 naïve " * 12), (408, "one two"), (409, "A b\x1cc\x0bd e")]
    rows += [(410, base[1]), (410, base[1]), (410, base[2]), (None, base[3]), (None, None)]
    return rows
