from pointweave.llm.common import hashed_words


def thue(k, a, b):
    s, t = a, b
    for _ in range(k):
        s, t = s + t, t + s
    return s, t


def test_words_that_collide_under_any_base_differ():
    for k in range(1, 14):
        for a, b in (("a", "b"), ("é", "x"), ("q", "z")):
            x, y = thue(k, a, b)
            h = hashed_words(f"{x} {y} {x.upper() if x.isascii() else x}\n{y}".encode())[2]
            assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1], k


def test_lower_case_and_blanks():
    """A-Z only, the six blanks only: É, a no-break space and U+0085 belong to words."""
    one = lambda t: hashed_words(t.encode())[2].tolist()
    assert one("AbC") == one("abc") and one("É") != one("é")
    assert len(one("a b\u0085c")) == 1 and len(one("a\tb\nc\x0bd\x0ce\rf g")) == 7
    assert one("") == []
