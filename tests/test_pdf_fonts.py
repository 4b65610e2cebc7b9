"""Fonts of files by one maker: their map is read once, and strings of codes show what they showed code by code."""

import random

from plinth.sources import pdf


def test_a_map_is_read_once_for_all_files(monkeypatch):
    read, plain = [], pdf._values
    monkeypatch.setattr(pdf, "_values", lambda data, at=0: read.append(data) or plain(data, at))
    pdf._font.cache_clear()
    for text in ("one", "two", "three \U0001f600"):
        file = pdf._File(pdf.write([[text]]))
        assert [file.text(*page) for page in file.pages()] == [text]
    assert sum(b"beginbfrange" in data for data in read) == 1


def test_strings_of_codes():
    r = random.Random(2)
    maps = [b"", b"1 beginbfrange <0000> <00FF> <0100> endbfrange 1 beginbfchar <0041> <D83DDE00> endbfchar"]
    for wide in (1, 2):
        for unicode_map in maps:
            font = pdf._font(wide, unicode_map)
            for _ in range(200):
                code = r.randbytes(r.randrange(8)) if r.random() < 0.5 else bytes(r.choice((0, 65)) for _ in range(r.randrange(8)))
                assert font.text(code) == "".join(font[int.from_bytes(code[i : i + wide])] for i in range(0, len(code), wide))
