"""Edit distance by whole diagonals and its bound from below, against the plain table."""

import random

from tripleforge.llm import editprint


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_and_bound():
    draw = random.Random(5)
    for k in range(300):
        letters = ["ab", "abcdefghij klm", [chr(97 + c) for c in range(400)]][k % 3]
        a = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        b = a[draw.randint(0, 3):] + "".join(draw.choice(letters) for _ in range(draw.randint(0, 9)))
        real, most = plain(a, b), draw.randint(0, 12)
        assert editprint.edit_distance(a, b, most) == (real if real <= most else None)
        assert editprint.least_edits(editprint.grams(a), editprint.grams(b)) <= real


def test_unlike_texts_need_no_search(monkeypatch):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    a, b = (" ".join(draw.choice(words) for _ in range(4000)) for _ in range(2))
    monkeypatch.setattr(editprint, "edit_distance", lambda *_: 1 / 0)
    assert not editprint._near(a, b, 0.05)
