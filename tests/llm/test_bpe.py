import hashlib

import pytest
from tokenizers import Tokenizer

from lexmill.llm import bpe


def check(df, **options):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in bpe.tokens(df, **options).collect()) == sorted(want)


def test_equals_the_library(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert bpe.tokens(none).count() == 0


def test_unicode(spark):
    texts = ["J̌ǰ ǰ", "ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "İI ıi", "a b　c d", "x<|startoftext|>Y <|endoftext|", "é é ﬁ ½ ²", "日本語 テキスト 12345", "don't WE'LL 'S", "🙃👩‍👩‍👧", "\u0000​", "<|endoftext|><|endoftext|>", "ẞß ŉ ĸ"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_whole_results(spark):
    row = bpe.tokens(spark.createDataFrame([(1, "Hello, WORLD")], "doc_id long, text string"), digest=False).first()
    assert row.decoded == "hello</w> ,</w> world</w>" and len(row.ids.split()) == row.n_tokens == 3


def test_many_units(docs):
    """Small units, a small memory of words and repeated texts give the same."""
    check(docs.unionByName(docs).coalesce(3), unit_bytes=20_000, known=50)


def test_other_order_fails(docs):
    """A source that deals its rows anew each time it is read must not mix up words."""

    def anew(batches):
        import os
        import random

        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))
        order = list(range(table.num_rows))
        random.Random(os.urandom(8)).shuffle(order)
        yield from table.take(order).combine_chunks().to_batches()

    unordered = docs.select("doc_id", "text").coalesce(1).mapInArrow(anew, "doc_id long, text string")
    with pytest.raises(Exception, match="another order"):
        bpe.tokens(unordered, unit_bytes=20_000).collect()


def test_units_keep_only_what_is_distinct():
    """A unit's words take some numbers for each piece of it, not several for each word of the whole."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    vocabulary = [f"{rng.choice('bcdfg')}{'aeiou'[k % 5]}{k}" for k in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=2000)) for _ in range(500)]
    splitter = bpe.Splitter(bpe.tokenizer_path())
    bpe.unit_words(splitter, pa.array(texts[:1]))
    column, size = pa.array(texts), sum(map(len, texts))
    tracemalloc.start()
    words, rows = bpe.unit_words(splitter, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [words[k] for k in rows[7]] == list(splitter.words(texts[7]))
    assert peak < 20 * size, peak / size
