import random
import zlib

import corpus_pipeline as pipeline
import numpy as np
from tokenizers import Tokenizer

from seriesmill.llm import packing

MARKED = [
    "one <|endoftext|> two", "<|startoftext|>The rain<|endoftext|>", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |> <|endoftext|", "naïve<|endoftext|>日本 it's",
    "e<|endoftext|>́ x1", "É<|endoftext|>", "<<|endoftext|>>", "'s<|startoftext|>'s", "<|endof", "text|> end",
]


def test_added_tokens_get_the_ids_of_an_untouched_tokenizer(spark, tmp_path):
    draw = random.Random(6)
    texts = MARKED + [draw.choice([" ", "", "\n"]).join(draw.choice(MARKED) for _ in range(draw.choice([3, 40, 400]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: plain.encode(text, add_special_tokens=False).ids + [0] for i, text in enumerate(texts)}
    assert 49407 in want[0] and 49406 in want[1] and 49407 not in want[3][:4]
    pieces = packing.op10_pack_sequences(spark, str(tmp_path)).collect()
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))
    for r in pieces:
        ids = want[r.doc_id][r.start : r.start + 2048]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    for r in pipeline.packed(spark, docs, "").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + 2048]
