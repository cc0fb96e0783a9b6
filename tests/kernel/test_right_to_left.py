"""Lines that are laid out here by the rule for right-to-left text must be read back as they were thought."""

import random

import pytest

from parchmill.kernel import bidi, document, writer
from parchmill.kernel.document import Options

#: Thaana letters at codes from 0x81 on; ASCII at its own codes. Every glyph is 0.6 em wide.
LETTERS = [chr(c) for c in range(0x0780, 0x07A6)]
CODE = {ch: 0x81 + i for i, ch in enumerate(LETTERS)} | {chr(c): c for c in range(0x20, 0x7F)}
CMAP = ("1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <81> <A6> <0780> <20> <7E> <0020> endbfrange").encode()
FONTS = {"F1": f"/Subtype /Type3 /FontMatrix [0.001 0 0 0.001 0 0] /FirstChar 0 /Widths [{' '.join(['600'] * 256)}] /ToUnicode 100 0 R"}
EM = 10


def shown(text, x, y):
    return f"1 0 0 1 {x} {y} Tm <{''.join(f'{CODE[ch]:02X}' for ch in text)}> Tj"


def lay_out(words, right_edge, y):
    """Each word from the right edge on leftwards: right-to-left ones with their letters the other way about, others as they are."""
    out, x = [], right_edge
    for w in words:
        x -= 0.6 * EM * len(w)
        out.append(shown(w[::-1] if w[0] in CODE and w[0] in LETTERS else w, x, y))
        x -= 0.6 * EM  # a space that nobody draws
    return out


def read(content, **options):
    pdf = writer.build([f"BT /F1 {EM} Tf\n" + "\n".join(content) + "\nET"], FONTS, {100: writer.stream(CMAP)})
    return "\n\n".join(t for _, _, t in document.pages(pdf, Options(**options)))


def some_words(rng):
    word = lambda: "".join(rng.choices(LETTERS, k=rng.randint(2, 6)))
    out = [word()]
    for _ in range(rng.randint(0, 4)):
        out += rng.choice([[word()], [str(rng.randint(2, 9999)), word()], [f"{rng.randint(1, 99)}.{rng.randint(10, 99)}", word()]])
    return out


@pytest.mark.parametrize("order", ["as read", "as it lies", "shuffled"])
def test_a_line_is_read_whatever_order_it_is_drawn_in(order):
    rng = random.Random(order)
    for _ in range(25):
        words = some_words(rng)
        parts = lay_out(words, 500, 700)
        if order == "as it lies":
            parts.reverse()
        elif order == "shuffled":  # after a right-to-left word; what is drawn before the first one stays together
            parts[1:] = rng.sample(parts[1:], len(parts) - 1)
        assert read(parts) == " ".join(words)


def test_two_columns_of_lines_and_a_line_of_latin():
    rng = random.Random(5)
    top, low = some_words(rng), some_words(rng)
    a, b = lay_out(top, 560, 700), lay_out(low, 560, 650)
    assert read([*a, *b, shown("plain words", 72, 600)]) == f"{' '.join(top)}\n{' '.join(low)}\nplain words"
    # the second halves of both lines after the first ones: each joins the line on which it lies
    assert sorted(read([*a[: len(a) // 2 + 1], *b, *a[len(a) // 2 + 1 :]]).split("\n")) == sorted([" ".join(top), " ".join(low)])


def test_letters_one_by_one_and_twice_for_bold():
    word = "".join(LETTERS[3:8])
    letters = [shown(ch, 300 - 0.6 * EM * i, 700) for i, ch in enumerate(word)]
    assert read(letters) == word
    assert read([x for part in letters for x in (part, part)]) == word


def test_drawn_backwards():
    word = "".join(LETTERS[10:14])
    assert read([f"{-1.2 * EM} Tc", shown(word, 400, 700)]) == word


def test_reading_order_of_pieces():
    a, b = "".join(LETTERS[:3]), "".join(LETTERS[4:7])
    for logical in (f"{a} {b}", f"{a} 12 {b}", f"{a} 1,200.50 {b}", f"{a} $5 {b}", f"{a} 7% {b}", f"{a} one two {b}", f"{a} {b} 3"):
        pieces = logical.split(" ")
        drawn, keep = [], []
        for p in pieces:  # words of other scripts stand together in their own order
            if p[0] in LETTERS:
                drawn += [" ".join(keep)] * bool(keep) + [p[::-1]]
                keep = []
            else:
                keep.append(p)
        drawn += [" ".join(keep)] * bool(keep)
        assert bidi.logical(" ".join(reversed(drawn))) == logical
    assert bidi.logical("only left to right, 42%") == "only left to right, 42%"
    assert bidi.logical(f"Latin first, {a[::-1]} and last") == f"Latin first, {a} and last"
    assert bidi.logical(f"){b[::-1]}( {a[::-1]}") == f"{a} ({b})" and bidi.logical("ﻼ") == "لا"
