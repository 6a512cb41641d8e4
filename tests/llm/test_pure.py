"""The parts of the corpus operators that need no Spark, against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadrille.llm import chat, decontaminate, license_scan, media, ngram_join, toxicity
from quadrille.llm.bpe import Automaton, Encoder
from quadrille.llm.common import word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "Hello wörld <|endoftext|> it's 123", "ΑΣ ΣΑΣ İ <|ENDOFTEXT|>", "don't ́é", "a" * 700, "中文 тест ½ ª² x\x1cy z", "I'LL 'Re n't", "​ x\x85y\xa0z", "éÉ×÷ßÿ"]


@pytest.fixture(scope="module")
def both():
    return Encoder(PATH), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", HARD)
def test_bpe_equals_library(both, text):
    mine, library = both
    want = library.encode(text, add_special_tokens=False)
    ids = mine.encode(text)
    assert ids.tolist() == want.ids
    assert mine.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_random_letters(both):
    mine, library = both
    r = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(r.choice("aeinrstél'9.") for _ in range(r.randint(1, 14))) for _ in range(8))
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_accepts_one_sequence():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b</w>")]
    names = ["a", "b", "a</w>", "b</w>", *[x + y for x, y in merges]]
    auto = Automaton({t: i for i, t in enumerate(names)}, merges).compile()

    def by_merging(word):
        s = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            k = 0
            while k < len(s) - 1:
                if s[k] == u and s[k + 1] == v:
                    s[k : k + 2] = [u + v]
                k += 1
        return s

    for n in range(1, 9):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert [names[t] for t in auto.encode_word(word)] == by_merging(word), word


def test_chat_escape_and_parse():
    r = random.Random(1)
    for _ in range(300):
        turns = [("".join(r.choice(["a", ":", "\\", "#", "###"]) for _ in range(4)), "".join(r.choice(["x", "\\", "#", "###", "</turn>", " </turn>\n", "\n", "<", ": "]) for _ in range(7))) for _ in range(3)]
        assert chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns)) == turns
    with pytest.raises(ValueError):
        chat.parse_turns("### a: b")


def test_media_round_trip_and_shots():
    for seed in range(10):
        p = np.random.default_rng(seed).integers(0, 256, media.FRAME * 4).astype(np.uint8).reshape(-1, 24, 24)
        assert (media.decode_frames(media.read_avi(media.write_avi(media.encode_frames(p)))) == p).all()
    for text in (None, "", "ÿ" * 1000, "x" * 576):
        n, data = media.store(text)
        assert media.decode_frames(media.read_avi(data)).tobytes() == media.payload_of(text)[1].tobytes()
    still = np.concatenate([np.full((20, 24, 24), 10, np.uint8), np.full((20, 24, 24), 200, np.uint8)])
    assert media.shots(still)[0] == [(0, 20), (20, 40)]
    without_index = media.write_avi(media.encode_frames(still)).replace(b"idx1", b"JUNK")
    assert (media.decode_frames(media.read_avi(without_index)) == still).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF    WAVE")


def test_patience_alignment():
    assert license_scan.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    a, b = "x the cat sat on the mat y".split(), "the cat sat quietly on the mat".split()
    assert [a[i] for i, _ in license_scan.patience_align(a, b)] == "the cat sat on the mat".split()
    found = license_scan.scan_text("foo.\nReleased under the MIT License.\nbar")
    assert [(x[0], x[1]) for x in found] == [("MIT", 1.0)]
    assert license_scan.scan_text("mit " * 50) == [] and license_scan.scan_text("") == []


def test_lcs_against_table():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 12))], [r.randint(0, 5) for _ in range(r.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs_length(a, b) == t[-1][-1]


def test_word_hashes_fold_and_split():
    a = word_hashes("The\x0bquick\x1cfox É x".encode())
    b = word_hashes("  tHE \t QUICK\x1cfox\nÉ X ".encode())
    assert a.tolist() == b.tolist() and len(set(a.tolist())) == 4
    assert word_hashes("É".encode()).tolist() != word_hashes("é".encode()).tolist() and len(word_hashes(b"")) == 0
    assert len(ngram_join.shingles("a b c")) == 1 and len(ngram_join.shingles(None)) == 0 and len(ngram_join.shingles("a b c d e f")) == 2


def test_noisy_or():
    m = toxicity.Model({p: 6.0 for p in toxicity.places("scum")}, -3.0)
    assert m.score(None)[0] == m.score("")[0] == toxicity.LEAK
    s, a, b = m.score("Fine day. You scum! Bye.")
    assert s > 0.9 and "scum" in "Fine day. You scum! Bye."[a:b]


def test_licenses_side_by_side_or_without_marker():
    near = "w " * 30 + "Released under the MIT License. Released under the MIT License. " + "w " * 30
    assert license_scan.scan_text(near) == [("MIT", 1.0, 60, 91 - 1, 5, 5)]
    grant = next(body for name, _, body in license_scan.TEMPLATES if name == "MIT-grant")
    for text in (grant.replace("sublicense, ", ""), grant.replace("sublicense", "sublicence")):
        assert [x[0] for x in license_scan.scan_text("w " * 30 + text + " w" * 30)] == ["MIT-grant"]
    assert [x[0] for x in license_scan.scan_text("Licensed under the Apahce License, Version 2.0.")] == ["Apache-2.0"]
    assert license_scan.scan_text("Released under the BSD License.") == [] == license_scan.scan_text("Licensed under CC BY 4.0.")


def test_differences_lose_no_pair():
    """Of three random sets, each similar pair that a pivot doesn't link shares a key at places that the join admits."""
    import numpy as np

    from quadrille.llm.ngram_join import BITS, _linked, difference_rows

    r = np.random.default_rng(3)
    sketch = r.integers(0, 9, 1 << BITS)
    pool = np.unique(r.integers(0, 1 << 63, 400).astype(np.uint64))
    met = 0
    for _ in range(1500):
        base = r.choice(pool, r.integers(1, 120), replace=False)

        def near(most):
            keep = base[r.random(len(base)) > r.random() * most]
            return np.unique(np.concatenate([keep, r.choice(pool, int(len(base) * r.random() * most), replace=False)]))

        p, x, y = near(0.9), near(0.2), near(0.2)
        if not len(x) or not len(y) or not len(p) or not _linked(x, y) or (_linked(x, p) and _linked(y, p)):
            continue
        met += 1
        keys = [{(bands, int(k)): (j, d) for bands, head, d in difference_rows(s, p, sketch) for j, k in enumerate(head)} for s in (x, y)]
        d, e = len(np.setxor1d(x, p)), len(np.setxor1d(y, p))
        t = max(1, -(-(7 * (d + e) - len(x) - len(y)) // 14))
        assert any(keys[0][k][0] <= d - t and keys[1][k][0] <= e - t for k in keys[0].keys() & keys[1].keys())
    assert met > 100


def test_links_within_a_group():
    """As many components as all pairs give, by real links, also with sets of one id, copies and empty sets."""
    import numpy as np

    from quadrille.llm.ngram_join import _linked, links_within

    r = np.random.default_rng(8)
    for count in (1, 2, 30, 90):
        base = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
        sets = [base[r.random(len(base)) > r.random() * 0.3][: r.integers(0, 3000)] for _ in range(count)]
        sets += [sets[0], base[:0]]
        ids = [k - (k == 7) for k in range(len(sets))]
        links = links_within(ids, sets)
        assert len(links) < len(sets)

        def parts(edges):
            group = {i: i for i in ids}
            while any(group[i] != group[j] for i, j in edges):
                for i, j in edges:
                    group[i] = group[j] = min(group[i], group[j])
            return group

        real = {(ids[i], ids[j]) for i in range(len(sets)) for j in range(len(sets)) if i != j and _linked(sets[i], sets[j])}
        assert set(links) <= real and parts(links) == parts(real)


def test_turns_of_marks_and_backslashes():
    from quadrille.llm.chat import format_turn, parse_turns

    for role, text in [("user", "\\"), ("a: b", "\\### x </turn>\n### user: y </turn>\n"), ("", ""), ("x\\", "\\\\</turn> \\</turn>"), (": ", " </turn>\n"), ("user", "z" * 3_000_000 + "\\")]:
        twice = format_turn(role, text)[0] * 2
        assert parse_turns(twice) == [(role, text)] * 2
    for broken in ("### user: x", "user: x </turn>\n", "### user x </turn>\n"):
        with pytest.raises(ValueError):
            parse_turns(broken)


def test_stored_frames_by_an_independent_reader():
    """The AVI is walked chunk by chunk and each frame is decoded bit by bit from its own tables."""
    from quadrille.llm.media import payload_of, store

    def frame(jpeg):
        at, codes = 2, {}
        while jpeg[at + 1] != 0xDA:
            size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
            if jpeg[at + 1] == 0xC4:
                counts, symbols, code = jpeg[at + 5 : at + 21], list(jpeg[at + 21 : at + 2 + size]), 0
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        codes[format(code, f"0{length}b")] = symbols.pop(0)
                        code += 1
                    code <<= 1
            elif jpeg[at + 1] == 0xC3:
                height, width = int.from_bytes(jpeg[at + 5 : at + 7], "big"), int.from_bytes(jpeg[at + 7 : at + 9], "big")
            at += 2 + size
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
        bits = "".join(format(b, "08b") for b in jpeg[at:-2].replace(b"\xff\0", b"\xff"))
        out, place = [], 0
        for k in range(height * width):
            end = place + 1
            while bits[place:end] not in codes:
                end += 1
            n = codes[bits[place:end]]
            raw = int(bits[end : end + n] or "0", 2)
            step = raw if n == 0 or raw >> (n - 1) else raw - (1 << n) + 1
            before = 128 if k == 0 else out[k - width] if k % width == 0 else out[k - 1]
            out.append(before + step)
            place = end + n
        return bytes(out)

    for text in (None, "abc", "é😀 " * 300, "\0\xff" * 700, "x" * 576):
        data, frames, at = store(text)[1], [], 12
        while at < len(data):
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":
                at += 12
                continue
            if name == b"00dc":
                frames.append(frame(data[at + 8 : at + 8 + size]))
            at += 8 + size + size % 2
        assert b"".join(frames) == payload_of(text)[1].tobytes()


def test_every_cut_is_found():
    import numpy as np

    from quadrille.llm.media import shots

    still = np.repeat(np.arange(0, 240, 16), 6).astype(np.uint8)
    frames = np.repeat(still, 576).reshape(-1, 24, 24)
    assert [a for a, _ in shots(frames)[0]] == list(range(0, 90, 6))
    assert [a for a, _ in shots(frames[4:8])[0]] == [0, 2] and shots(frames[:6])[0] == [(0, 6)]


def test_bpe_words_in_use_stay_known(monkeypatch):
    """Words that come again and again are encoded once, however many others come between; all as the library does."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from quadrille.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    e, library, r, seen = bpe.Encoder(path), Tokenizer.from_file(path), random.Random(3), []
    encode = e.automaton.encode_word
    monkeypatch.setattr(e.automaton, "encode_word", lambda w: seen.append(w) or encode(w))
    words = ["".join(r.choice(["th", "e", "an", "ing", "st", "q", "é", "!"]) for _ in range(r.randint(1, 12))) for _ in range(300)] + ["!" * 5000, "a" * 3000, "日本語", "x</w>y"]
    for w in words:
        text = f"often {w}"
        assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert seen.count("often") == 2  # once in plain text, once beside a word that is split by the library
