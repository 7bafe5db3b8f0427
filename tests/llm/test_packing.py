import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import documents
from tokenizers import Tokenizer

from facsimile.llm import packing


@pytest.fixture(scope="module")
def path():
    return packing.public_tokenizer()


def checked(rows, texts, path):
    """Every piece against ids made in the plain way; returns the padding and the tokens."""
    tokenizer = Tokenizer.from_file(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, sum(r.length for r in rows)


def test_driver_table(spark, sf_dir, path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.query(spark, sf_dir).collect()
    padding, tokens = checked(rows, docs, path)
    assert padding < 0.02 * tokens
    # documents keep their order: sequences follow one another within a block
    order = [(r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.block, r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_edges(spark, path):
    texts = {0: None, 1: "", 2: " \n ", 3: "No end here " * 4000, 4: "A. B! C? " * 3000, 5: "<|endoftext|> İ ǅ ﬁ don't",
             6: "<|ENDOFTEXT|> a", 7: "漢字" * 3000, 9_000_000: "far", -5: "below"}
    rows = packing.pack(documents(spark, list(texts.values()), ids=list(texts), start="clash", block="clash"), path).collect()
    checked(rows, texts, path)
    assert packing.pack(documents(spark, []), path).count() == 0
    again = packing.pack(documents(spark, ["a b", "a b", None, None], ids=[3, 3, None, None]), path).collect()
    assert sorted((r.doc_id is None, r.length) for r in again) == [(False, 3), (False, 3), (True, 1), (True, 1)]
    assert len({(r.sequence_id, r.offset) for r in again}) == 4


def test_words_apart_give_the_ids_of_whole_texts(path):
    draw = random.Random(3)
    pool = ["A", "á", " ", " ", "\n", "Ï", "Σ", "'s", "don't", "<|endoftext|>", "<|STARTOFTEXT|>", "12", "b.", "..", ",", "|",
            "漢字", "!?", "\x1c", "\x85", " ", "e", "̸", "🙂", "‍", "ﬁ", "_", "é", "&&&", "$"]
    plain = Tokenizer.from_file(path)
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(14))) for _ in range(4000)]
    small = packing.Encoder(path)
    small.LIMIT = 300  # tables that often start anew
    small.TOGETHER = 400
    for text, (ids, _) in zip(texts, small.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_letters_of_every_kind_give_the_ids_of_the_rules(path):
    coder = packing.Encoder(path)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x20, 0x250) for a in ("", "x", "É") for b in ("", "é")]
    texts += [" ".join(texts), "İstanbul Σίσυφος ΣΑΣ", "it's I'LL Ünder<|x", "naïve-Café ﬁ ǅ", "e\u0301te\u0301", "A" * 5000]
    for text, (ids, _) in zip(texts, coder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_cuts_are_the_cheapest():
    draw = random.Random(4)
    for _ in range(150):
        places = sorted({draw.randrange(1, 60) for _ in range(draw.randrange(1, 12))})
        places = sorted({*places, *range(7, places[-1], 7)})
        penalties = [draw.choice([0, 1, 5]) for _ in places]
        window, exact = 8, (4,)

        def cost(ends):
            total, at = 0, 0
            for e in ends:
                if e - at > window:
                    return 10**9
                total += (0 if e - at in exact else window - (e - at)) + penalties[places.index(e)]
                at = e
            return total

        best, inner = 10**9, places[:-1]
        if len(inner) > 14:
            continue
        for chosen in range(1 << len(inner)):
            best = min(best, cost([p for k, p in enumerate(inner) if chosen >> k & 1] + places[-1:]))
        assert cost(packing.best_cuts(places, penalties, window, exact)) == best
