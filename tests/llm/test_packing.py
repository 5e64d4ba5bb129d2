import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
from cases import ODD, empty, odd

from tidegrid.llm.packing import OpenBins, WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["<|endoftext|> Hello <|startoftext|>x don't DON'T we'll ''s ,'s a\x1cb é é ́x ½ µ º İ Σας ΣΑΣ 中文 x y z a\x85b 12.5 \t\tq", "", " \n ", "12345", "naïve,Ünïcode-ß's 'S", "×÷ª"]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for text in HARD + [r[1] for r in ODD if r[1]]:
        assert mine.encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_pieces_rebuild_the_documents(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rows = pack(odd(spark), PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in {r[0]: r[1] for r in ODD}.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        if doc_id == 2:  # a repeated row
            assert len(pieces) == 2 * -(-len(ids) // 2048)
            continue
        assert [(p.piece, p.start) for p in pieces] == [(k, 2048 * k) for k in range(-(-len(ids) // 2048))]
        for p in pieces:
            part = array("I", ids[p.start : p.start + p.length])
            assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.length == min(2048, len(ids) - p.start)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert pack(empty(spark), PATH).count() == 0


def test_another_tokenizer_is_used_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, mine = Tokenizer.from_file(path), WordEncoder(path)
    assert not mine.by_word and WordEncoder(PATH).by_word
    for text in HARD + [r[1] for r in ODD if r[1]]:
        assert mine.encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def plain_best_fit(lengths, capacity, most):
    """Bounded-space best fit over a list of open bins: the place of each piece."""
    opened, out, n = [], [], 0
    for length in lengths:
        fitting = [b for b in opened if b[1] >= length]
        if fitting:
            least = min(b[1] for b in fitting)
            chosen = [b for b in fitting if b[1] == least][-1]
            opened.remove(chosen)
        else:
            if len(opened) >= most:
                fullest = min(b[1] for b in opened)
                opened.remove([b for b in opened if b[1] == fullest][-1])
            chosen, n = [n, capacity], n + 1
        out.append((chosen[0], capacity - chosen[1]))
        chosen[1] -= length
        if chosen[1]:
            opened.append(chosen)
    return out


def test_bins_equal_plain_best_fit():
    rng = random.Random(2)
    for capacity, most in ((10, 3), (64, 8), (2048, 40)):
        lengths = [rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, 2 + capacity // 8)]) for _ in range(3000)]
        bins = OpenBins(capacity, most)
        assert [bins.place(x) for x in lengths] == plain_best_fit(lengths, capacity, most)


def test_the_tails_of_many_tasks_are_merged(spark):
    """With ties and repeated rows; about as many sequences from 211 tasks as from one."""
    docs = spark.createDataFrame([(k // 2, "word " * (50 + 37 * (k % 40))) for k in range(800)], "doc_id long, text string")
    sizes = []
    for tasks, in_task in ((1, 50_000), (211, 50_000), (211, 200)):
        rows, fill = pack(docs.repartition(tasks), PATH, tails_in_task=in_task).collect(), Counter()
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill[r.sequence_id]
            fill[r.sequence_id] += r.length
        assert len(rows) == 800 and max(fill.values()) <= 2048
        sizes.append(len(fill))
    assert sizes[1] <= 1.03 * sizes[0] and sizes[2] <= 1.06 * sizes[0]


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert bins.place(4) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # three places left in bin 1, six in bin 0
    assert bins.place(8) == (2, 0)  # bins 0 and 2 are open
    assert bins.place(9) == (3, 0)  # bin 2 was the fullest and is closed
    assert bins.place(2) == (0, 4)
