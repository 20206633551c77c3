"""What tasks hold at a time: Arrow batches of texts, words that the encoder keeps."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartweave.llm import near_dedup, token_codes
from chartweave.llm.queries import TOKENIZER
from chartweave.llm.shared import BATCH_BYTES

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def long_texts(spark):
    """12 MB of texts in one part."""
    words = F.concat_ws(" ", F.lit("row"), F.col("doc_id"), F.repeat(F.lit("some words "), 370))
    return spark.range(3000).toDF("doc_id").repartition(1).withColumn("text", words)


def bounded(make):
    """The task function that ``make`` returns, failing on a batch far beyond BATCH_BYTES."""
    most = 2 * BATCH_BYTES

    def outer(*args):
        run = make(*args)

        def seen(batches):
            for batch in batches:
                assert batch.nbytes <= most, f"a batch of {batch.nbytes} bytes"
                yield batch

        return lambda batches: run(seen(batches))

    return outer


def test_token_codes_take_short_batches(spark, monkeypatch):
    monkeypatch.setattr(token_codes, "_encoded", bounded(token_codes._encoded))
    before = spark.conf.get(CONF)
    found = token_codes.token_codes(long_texts(spark), public_tokenizers.path(TOKENIZER))
    assert found.count() == 3000
    assert spark.conf.get(CONF) == before


def test_near_dedup_takes_short_batches(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_sketches", bounded(near_dedup._sketches))
    before = spark.conf.get(CONF)
    found = near_dedup.near_duplicates(long_texts(spark), width=2)
    assert found.count() == 3000
    assert spark.conf.get(CONF) == before


def test_encoder_ids_and_bounds(monkeypatch):
    path = public_tokenizers.path(TOKENIZER)
    plain = Tokenizer.from_file(path)
    texts = ["", " \t\n", "A word,  a WORD | a|b ||", "naïve été don't ¦ <|endoftext|>x", "12 345 中文 " * 200, "|"]
    for kept, line in ((token_codes.KEPT_BYTES, 64), (0, 1), (0, 3)):
        monkeypatch.setattr(token_codes, "KEPT_BYTES", kept)
        monkeypatch.setattr(token_codes, "LINE_WORDS", line)
        encoder = token_codes.WordEncoder(path)
        for _ in range(2):
            ids, sizes = encoder.encode(pa.array(texts, pa.large_string()))
            want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
            assert sizes.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
    # Words that never come again are not kept beyond the limit.
    monkeypatch.setattr(token_codes, "KEPT_BYTES", 20_000)
    encoder = token_codes.WordEncoder(path)
    for at in range(0, 5000, 500):
        encoder.encode(pa.array([" ".join(f"w{i}" for i in range(at, at + 500))]))
    assert len(encoder._kept) <= 2000


def test_block_reads_many_and_few_places_alike():
    ids = np.random.default_rng(3).integers(0, 70_000, 5_000).astype(np.uint32)
    block = token_codes.Block(token_codes.encode_block(ids))
    assert (block.ids(np.arange(len(ids))) == ids).all()
    places = np.array([0, 7, 511, 512, 513, 4_999, 2_048])
    assert (block.ids(places) == ids[places]).all()


def test_tasks_of_a_worker_encode_a_word_once(monkeypatch):
    encode, seen = token_codes.WordEncoder._words, []
    monkeypatch.setattr(
        token_codes.WordEncoder, "_words", lambda self, new: seen.extend(map(str, new)) or encode(self, new)
    )
    forms = [w for i in range(300) for w in (f"zq{i}v", f"ZQ{i}v.", f"(Zq{i}V)", f"zq{i}v,zq{i}v")]
    texts = [" ".join(forms[at : at + 100]) for at in range(0, len(forms), 100)]
    batch = pa.RecordBatch.from_pydict({"part": pa.array([0] * 12, pa.int32()), "doc_id": range(12), "text": texts})
    run = token_codes._encoded(public_tokenizers.path(TOKENIZER), 1)
    first, again = list(run(iter([batch, batch]))), list(run(iter([batch])))
    assert sum(b.num_rows for b in first) == sum(b.num_rows for b in again) == 1
    # zq, v, 300 numbers and four kinds of signs; before, 1,200 words in each of two tasks.
    assert len(seen) == len(set(seen)) <= 306


def test_encoder_cuts_only_where_the_tokenizer_does(monkeypatch):
    path = public_tokenizers.path(TOKENIZER)
    plain, encoder, dice = Tokenizer.from_file(path), token_codes.WordEncoder(path), np.random.default_rng(11)
    assert encoder._pieced
    signs = [*"aAhHtTsSrReElLmMiI", *"'''.,!<>=\"|#$", *"012", *" \t\n\x0b", *"éÉñßİΣς中文가²½…’", "̱", "́", "̸"]
    signs += ["'RE", "'ll", "K", " ", "\u0085", "\x1c", "\x00", "\x7f", "٣"]
    for added in ([], ["<|endoftext|>", "<|ENDOFTEXT|>"]):
        for kept in (token_codes.KEPT_BYTES, 3_000, 0):
            monkeypatch.setattr(token_codes, "KEPT_BYTES", kept)
            texts = ["".join(dice.choice(signs + added, dice.integers(0, 40))) for _ in range(600)]
            ids, sizes = encoder.encode(pa.array(texts, pa.large_string()))
            want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
            assert sizes.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
