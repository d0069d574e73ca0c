"""Phrases against brute force, and broken and wrapped expressions after an identifier tag."""

import random
import re

from tessera.llm import licenses
from tessera.llm.licenses import Scanner

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_scan_against_brute_force(spark):
    """Places of phrases, labels and scores as a search word by word finds them, in texts of phrases, parts of phrases and others."""
    rng = random.Random(6)
    weights = {p: (l, 0.8) for p, l in licenses.BASE.items()} | licenses.NOTICES
    pool = [*weights, *[" ".join(p.split()[:-1]) for p in weights], "foo", "MIT", "é", "spdx license identifier", "the", "under the mit", "cc by", "x1"]
    made = []
    for i in range(120):
        words = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))).split(" ")
        words = [w.upper() if rng.random() < 0.2 else w for w in words]
        made.append((i, "".join(w + rng.choice([" ", "-", ". ", "\n", "\u2003 ", "/"]) for w in words)))
    made += [(200, None), (201, ""), (None, "Under the MIT License"), (202, "under the mit license " * 3000)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for doc_id, text in made:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        places, labels = [], {}
        for phrase, (label, weight) in weights.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            if at:
                labels[label] = max(weight, labels.get(label, 0))
                places += at if phrase in licenses.BASE else []
        r = got[doc_id]
        base = sorted({l for p, l in licenses.BASE.items() if any(words[i : i + len(p.split())] == p.split() for i in places)})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), base)
        assert set(labels) <= set(r.labels)
        if not any(words[i : i + 3] == ["spdx", "license", "identifier"] for i in range(len(words))):
            miss = 1.0
            for w in labels.values():
                miss *= 1 - w
            assert r.labels == sorted(labels) and abs(r.score - (1 - miss)) < 1e-9
    look = Scanner()
    assert look("SPDX\nLicense-Identifier: MIT")["labels"] == [] and look("a spdx-LICENSE identifier = (mit)\n")["labels"] == ["mit"]
    assert look("é SPDX-License-Identifier: Zlib\nspdx license identifier BSD-2-Clause")["expressions"] == ["zlib", "bsd-2-clause"]


def test_broken_and_wrapped_expressions():
    look, tag = Scanner(), "SPDX-License-Identifier: "
    labels = lambda text: look(tag + text)["labels"]
    assert labels("(MIT OR Apache-2.0") == ["apache-2.0", "mit"] and labels("Apache-2.0 AND (MIT") == ["apache-2.0", "mit"]
    assert labels("(MIT OR Apache-2.0 some prose follows") == ["apache-2.0", "mit"]
    assert labels("MIT OR\nCopyright 2020 Foo") == ["mit"] and labels("(MIT OR\n\nZlib)") == ["mit"] and labels("OR") == []
    assert labels("(MIT OR Apache-2.0\n// Copyright 2020 Foo") == ["apache-2.0", "mit"]
    got = look("// " + tag + "(MIT OR\n//   Apache-2.0)\n//  AND BSD-3-Clause\nint main")
    assert got["labels"] == ["apache-2.0", "mit"] and got["expressions"] == ["mit apache-2.0 or"] and got["permissive"]
    got = look("# " + tag + "GPL-2.0 AND\n# (MIT OR\n# Zlib\n# )\nimport os")
    assert got["labels"] == ["gpl-2.0", "mit", "zlib"] and got["expressions"] == ["gpl-2.0 mit zlib or and"]
    assert look(tag + "MIT OR\n" + tag + "Zlib")["labels"] == ["mit", "zlib"]
    assert look(tag + "MIT this is prose")["labels"] == ["mit"]
