"""The added literals of operator 4 against a reading that carries every literal along, and long texts."""

import random
import time

import pytest

from lorekeep.llm import secrets


def carried(text):
    """Every name with all the literals it stands for, assignment by assignment; a base span is
    looked for among all of them."""
    known, scores = {}, {}
    for name, literals, uses in secrets.pairs(text):
        known[name] = {*literals, *(x for u in uses for x in known.get(u, ()))}
        for a, b in known[name]:
            score = secrets.name_weight(name) * secrets.literal_weight(text[a:b])
            scores[a, b] = max(score, scores.get((a, b), 0.0))
    base = [(*s, 1.0) for s in secrets.base_spans(text)]
    added = [
        ("literal", a, b, score)
        for (a, b), score in scores.items()
        if score >= secrets.LEAST_SCORE and not any(s <= a and b <= e for _, s, e, _ in base)
    ]
    return sorted([*base, *added], key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


@pytest.mark.parametrize("seed", range(40))
def test_as_if_carried(seed):
    rng = random.Random(seed)
    names = ["a", "b", "user_key", "dbPassword", "auth", "API_KEY", "token", "passphrase", "x1"]
    word = lambda: "".join(rng.choices("abcXYZ0189/+", k=rng.randint(6, 24)))
    term = lambda: rng.choice([f'"{word()}"', f"'{word()}'", rng.choice(names), word(), "AKIA" + "Q7" * 10, "0a1b" * 5])
    line = lambda: f"{rng.choice(names)}{rng.choice([' = ', ': ', ' := ', ' => '])}{' + '.join(term() for _ in range(rng.randint(1, 3)))}"
    text = "\n".join(line() for _ in range(rng.randint(1, 60)))
    got, want = secrets.spans(text, True), carried(text)
    assert [s[:3] for s in got] == [s[:3] for s in want]
    assert [s[3] for s in got] == pytest.approx([s[3] for s in want])


@pytest.mark.parametrize(
    "line", ['password = "Zx81kQp0vv9{n:07d}"\nhash: 0123456789abcdef{n:016x}', 's = s + "part{n:07d}Qz"']
)
def test_long_texts_cost_by_their_length(line):
    """100,000 lines; quadratic work would take minutes."""
    text = "\n".join(line.format(n=n) for n in range(50_000 if "\n" in line else 100_000))
    before = time.perf_counter()
    found = secrets.spans(text + "\nauth_token = s", True)
    assert time.perf_counter() - before < 20
    # Only literals that a sensitive name reaches: the whole chain in the second text.
    assert len(found) >= 100_000


def test_the_last_assignment_before_the_use_counts():
    text = 'k = "aB3dE6gH9kL"\npassword = k\nk = "zY8xW5vU2tS"\nname = k\n'
    found = [text[a:b] for kind, a, b, _ in secrets.spans(text, True) if kind == "literal"]
    assert found == ["aB3dE6gH9kL"]
