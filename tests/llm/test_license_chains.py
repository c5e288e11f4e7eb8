"""Occurrences with foreign words inside are one find with their whole coverage."""

from __future__ import annotations

import random
import time

import pytest

from boutlake.llm import license_scan

INDEX = license_scan.build_index(license_scan.TEMPLATES)
MIT = license_scan.TEMPLATES["MIT"]


def foreign(n: int) -> str:
    return " ".join(f"zq{i}" for i in range(n))


def with_breaks(at: list[int], n: int) -> str:
    words = MIT.split()
    edges = [0, *at, len(words)]
    return f" {foreign(n)} ".join(" ".join(words[a:b]) for a, b in zip(edges, edges[1:]))


def mit(text: str):
    return [f for f in license_scan.scan_text(text, INDEX, 0.6, 16) if f[0] == "MIT"]


@pytest.mark.parametrize("at,n", [([80], 40), ([80], 17), ([40, 80, 120], 40), ([20, 40, 60, 80, 100, 120, 140], 12), ([80], 150)])
def test_foreign_words_inside(at, n):
    text = with_breaks(at, n)
    found = mit(f"lorem {text} dolor")
    assert [f[1] for f in found] == [1.0]
    assert "zq" not in "".join(f"lorem {text} dolor"[a:b] for a, b in found[0][3])


def test_pieces_too_far_apart_stay_apart():
    assert mit(with_breaks([80], 400)) == []


def test_damaged_copies_side_by_side_stay_apart():
    cut = " ".join(MIT.split()[:140])
    found = mit(f"{cut} {foreign(3)} {MIT} {foreign(3)} {cut} {foreign(3)} {with_breaks([80], 40)}")
    part, whole = len(license_scan.words_of(cut)), len(license_scan.words_of(MIT))
    assert [f[2] for f in found] == [part, whole, part, whole]


def test_many_notices_in_one_text():
    text = f"{license_scan.TEMPLATES['MIT-notice']} " * 3000
    assert len([f for f in license_scan.scan_text(text, INDEX, 0.6, 16) if f[0] == "MIT-notice"]) == 3000


def full_alignment(a: list[str], b: list[str]) -> int:
    """Matched words of a best Smith-Waterman alignment (2, -1, -1) of all of a with all of b."""
    rows = [[(0, 0)] * (len(b) + 1)]
    best = (0, 0)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b):
            d = rows[-1][j]
            step = (d[0] + 2, d[1] + 1) if x == y else (d[0] - 1, d[1])
            up, left = rows[-1][j + 1], row[-1]
            row.append(max(step, (up[0] - 1, up[1]), (left[0] - 1, left[1]), (0, 0)))
        best = max(best, max(row))
        rows.append(row)
    return best[1]


@pytest.mark.parametrize("seed", range(12))
def test_random_edits_by_full_alignment(seed):
    """Words struck, changed and put in at random: as many words are matched as by the full alignment, less what a joint may lose."""
    rng = random.Random(seed)
    name = rng.choice(["MIT", "ISC", "Zlib", "BSD-3-Clause", "Unlicense"])
    words = license_scan.TEMPLATES[name].split()
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < 0.04 else [f"zq{rng.randrange(99)}"] if x < 0.08 else [w, *(f"zp{k}" for k in range(rng.randrange(1, 4)))] if x < 0.11 else [w]
    text = f"{foreign(30)} {' '.join(out)} {foreign(30)}"
    found = [f for f in license_scan.scan_text(text, INDEX, 0.6, 16) if f[0] == name]
    want = full_alignment(license_scan.words_of(license_scan.TEMPLATES[name]), license_scan.words_of(text))
    assert len(found) == 1 and 0.97 * want <= found[0][2] <= len(license_scan.words_of(license_scan.TEMPLATES[name]))


@pytest.mark.parametrize("n", [20, 33, 60, 100, 150])
@pytest.mark.parametrize("breaks", [1, 2, 3])
def test_insertions_of_any_length(n, breaks):
    """A template's words are all found whatever is put in at one or more places, up to its own length each."""
    size = len(MIT.split())
    at = [size * (k + 1) // (breaks + 1) for k in range(breaks)]
    found = mit(f"{foreign(40)} {with_breaks(at, n)} {foreign(40)}")
    assert [f[1] for f in found] == [1.0]


def test_many_copies_and_scraps_are_cheap():
    """80 copies are all found; thousands of shuffled scraps of six words are no occurrence, and neither takes long."""
    began = time.process_time()
    found = license_scan.scan_text(" foo ".join([MIT] * 80), INDEX, 0.6, 16)
    assert [(f[0], f[1]) for f in found] == [("MIT", 1.0)] * 80
    words, rng = MIT.split(), random.Random(1)
    scraps = [words[i : i + 6] for i in range(len(words) - 6)]
    assert license_scan.scan_text(" ".join(w for _ in range(3000) for w in rng.choice(scraps)), INDEX, 0.6, 16) == []
    assert time.process_time() - began < 15  # 40 s with one alignment a diagonal
