import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from relaudit.llm import features, packing


def contents(bins):
    out = Counter()
    for held, n in zip(bins.content, bins.count, strict=True):
        if n:
            assert sum(x * m for x, m in held) <= bins.capacity
            out.update({x: 0 for x, _ in held})
            for x, m in held:
                out[x] += m * n
    return out


def test_plan_places_every_piece_and_comes_near_the_bound():
    rng = random.Random(1)
    for _ in range(100):
        histogram = {rng.randint(1, 4096): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
        assert contents(packing.plan(histogram)) == Counter(histogram)
    many = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bins = packing.plan(many)
    assert sum(bins.count) <= 1.002 * sum(x * n for x, n in many.items()) / 4096 + 1
    assert packing.plan({}).count == []


def test_ids_equal_the_tokenizer():
    tokenizer = packing._tokenizer(packing.TOKENIZER)[0]
    odd = ["", " ", "Hello, WORLD!!", "don't I'LL x's", "a\x1cb\tc\r\nd", "e<|endoftext|>x <|endoftext|>", "É é ́x", "12 a1b2", "x_y --", "İ ǅ ß ẞ", "中文 q　z", "Ab.c, -- 'quoted' ''", "日本。 ok."]
    for text, ids in zip(odd, packing.token_ids(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pack_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "Beta,", "gamma-ray", "delta."], k=rng.choice([0, 1, 30, 400, 6000]))) for _ in range(60)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(100, None, 7), (101, "", 7), (5, texts[5], 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)).collect()
    whole = {i: packing.token_ids([t or ""])[0] + np.array([1], "<u4").tobytes() for i, t, _ in rows}
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, *_ in rows)
    sequences = defaultdict(list)
    for r in got:
        part = whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.start == 4096 * r.piece and len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= sum(r.length for r in got) / 4096 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sizes_of_parts_outlive_a_task(monkeypatch):
    """A task's end leaves a bounded number of sizes, which the next one looks up; counts stay those of the ids."""
    from collections import Counter

    texts = ["the quick brown fox, the 12 foxes", "ein müder hund!", "日本 the", ""]
    parts = [packing.parts_of(t, t.lower(), Counter(packing.LETTERS.findall(t.lower()))) for t in texts]
    want = [len(x) // 4 for x in packing.token_ids(texts)]
    packing.forget_sizes()
    assert packing.token_counts(parts) == want
    packing.forget_sizes(100)
    encode, asked = packing._encoded, []
    monkeypatch.setattr(packing, "_encoded", lambda new, *a: asked.extend(new) or encode(new, *a))
    assert packing.token_counts(parts) == want and not asked
    packing.forget_sizes(3)
    assert len(packing._SIZES) == 3
    assert packing.token_counts(parts) == want and asked
    packing.forget_sizes()
    assert not packing._SIZES


ODDITIES = ["", " ", "the quick Brown fox, the 12 foxes!", "Ein müder HUND\x85und\xa0ªº µ ² × ÷", "ÀÉß ÿ'x <|endoftext|>", "a<|b", "x_y --\t9\x1cz", "日本 Ÿ K ǅ the", "Ÿ", "tab\tline\nline\r\x0b\x0c-", "".join(map(chr, range(256)))]


def test_new_words_go_to_the_model_and_plain_texts_pass_no_pattern(monkeypatch):
    """Letters are neither normalised nor parted again, and no pattern walks over texts of one byte a character."""

    class Others:
        def __init__(self, tokenizer):
            self.model = tokenizer.model
            self.encode_batch_fast = lambda parts, **k: [] if not any(map(packing.LETTERS.fullmatch, parts)) else 1 / 0

    tokenizer, read, _ = packing._tokenizer(packing.TOKENIZER)
    words = ["zebra", "müdigkeit", "ßàÿ", "qxzvw" * 40]
    got = packing._encoded(words, Others(tokenizer), read)
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in got.items()} == {w: tokenizer.encode(w, add_special_tokens=False).ids for w in words}
    assert packing._encoded([*words, "12", "<"], tokenizer, None, True) == packing._encoded([*words, "12", "<"], tokenizer, read, True)
    classes, plain = features._classes(), [t for t in ODDITIES if max(t, default="") < "Ā"]
    want = [features.measure(t, None, classes) for t in plain]
    monkeypatch.setattr(features, "WORD", None)
    monkeypatch.setattr(packing, "ODD", None)
    parts = []
    assert [features.measure(t, None, classes, parts) for t in plain] == want and len(parts) == len(plain)


def test_texts_of_one_byte_a_character_measure_like_any(monkeypatch):
    classes, weights = features._classes(), features.Weights({"the$": 1.0, "m": 0.5, "ß$": 2.0})
    want, parts = [features.measure(t, weights, classes) for t in ODDITIES], []
    for t in ODDITIES:
        low = t.lower()
        count = Counter(features.WORD.findall(low))
        parts.append(packing.parts_of(t, low, count))
        if packing.ODD.search(t):
            assert parts[-1] == (Counter(t.replace("\n", " ").split(" ")),)
        else:
            assert parts[-1] == (count, Counter(re.findall(r"[^\sa-zß-öø-ÿ]+", low)))
    assert packing.token_counts(parts) == [len(x) // 4 for x in packing.token_ids(ODDITIES)]
    monkeypatch.setattr(features, "latin", lambda text: None)
    assert [features.measure(t, weights, classes) for t in ODDITIES] == want
