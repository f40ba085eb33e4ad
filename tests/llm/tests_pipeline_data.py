"""A small corpus with planted cases, and what each stage must keep and drop."""

import random

WORDS = {"en": "the and of was with which there from that would been house river stone".split(),
         "de": "der und ist nicht durch werden größe schön straße zwischen haben über".split()}


def documents():
    rng = random.Random(12)

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang]) for _ in range(n))

    bench = [(i, prose("en", 30)) for i in range(3)]
    docs = [(i, prose("en" if i % 2 else "de", 80), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(60)]
    clean = set(range(60))
    docs += [(100, None, "en", "s0", 0), (101, "123 %%%", "en", "s0", 1)]
    docs += [(110, docs[3][1].upper(), "en", "s1", 1), (111, docs[4][1] + " und", "de", None, 1)]
    docs += [(120, prose("en", 20) + " " + bench[1][1] + " " + prose("en", 20), "en", "s1", 1)]
    known = clean | {110, 111, 120}
    return docs, bench, [(known, {100, 101}), (clean | {120}, {110, 111}), (clean, {120}), (set(), {100, 101, 110, 111, 120})]
