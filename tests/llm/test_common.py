import numpy as np

from threadloom.llm import common, pii
from threadloom.llm.boosting import Trees


def test_workers_drop_what_other_tasks_kept():
    """A worker outlives its stage: an encoder of one stage is not held through the next ones."""
    common._kept.clear()
    made = [common.kept(("encoder", 1), lambda: object()) for _ in range(2)]
    assert made[0] is made[1] and list(common._kept) == [("encoder", 1)]
    assert list(common.lean(lambda batches: (x + 1 for x in batches), "encoder")(iter([1, 2]))) == [2, 3] and len(common._kept) == 1
    assert list(common.lean(lambda batches: (len(common._kept) for _ in batches))(iter([1, 2]))) == [0, 0]


def test_stages_leave_no_encoder(spark):
    """What a task of another stage finds in a worker that has encoded."""
    from pyspark.sql import functions as F

    from threadloom.llm import sentencepiece_codec
    from threadloom.llm.entries import tokenizer_path

    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model")).collect()

    def held(frames):
        for frame in frames:
            yield frame.assign(id=len(common._kept))

    assert {r.id for r in spark.range(8).mapInPandas(common.lean(held), "id long").collect()} == {0}


def test_spans_are_described_in_parts():
    """A batch of many texts is never described at once, and the parts give what single texts do."""
    sizes = []

    class Counted(Trees):
        def predict(self, x):
            sizes.append(len(x))
            return super().predict(x)

    model = pii.Model(Counted(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 5.0), np.full(len(pii.KINDS), 0.9))
    texts = [f"n {i} call 303-555-{i:04} or x(at)y{i}.com, mail a{i}@b.cc" for i in range(1000)]
    together = pii.select(texts, model)
    assert sum(sizes) >= 2000 and max(sizes) <= 4 * pii.ROWS
    assert together == [pii.select([t], model)[0] for t in texts]
