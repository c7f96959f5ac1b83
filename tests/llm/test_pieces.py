import random

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto

from tickerloom.llm import pieces
from tickerloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces._vocabulary_bytes(pieces.MODEL))


@pytest.fixture(scope="module")
def library():
    """The library's own best segmentation with the same pieces and scores."""
    model = proto.ModelProto()
    model.ParseFromString(pieces._vocabulary_bytes(pieces.MODEL))
    model.trainer_spec.model_type = 1
    return SentencePieceProcessor(model_proto=model.SerializeToString())


def plain_best(word, vocabulary):
    """The greatest sum of scores over all segmentations, by recursion on the end."""
    best = [0.0]
    for end in range(1, len(word) + 1):
        options = [
            best[i] + vocabulary.scored[word[i:end]][0] for i in range(end) if word[i:end] in vocabulary.scored
        ]
        best.append(max(options, default=best[end - 1] + vocabulary.unknown))
    return best[-1]


def test_never_worse_than_the_library(docs, vocabulary, library):
    words = sorted({w for r in docs.limit(60).collect() for w in (r.text or "").split()})
    equal = 0
    for word, ids in zip(words, pieces.Encoder(vocabulary).encode(words), strict=True):
        theirs = library.encode(word)
        score = lambda found: sum(library.get_score(i) for i in found)
        if not any(i in vocabulary.byte_of for i in [*ids, *theirs]):
            assert score(ids) >= score(theirs)
            assert library.decode(ids) == word
        equal += ids == theirs
    assert equal > 0.95 * len(words)


def test_best_of_all_segmentations(vocabulary):
    rng = random.Random(3)
    words = {"▁" * rng.randint(0, 3) + "".join(rng.choices("theinaro▁é", k=rng.randint(0, 9))) for _ in range(300)}
    words.discard("")
    encoder = pieces.Encoder(vocabulary)
    encoder.learn(words)
    for word in words:
        ids = encoder.known[word]
        assert "".join(vocabulary.pieces[i] for i in ids) == word
        score = sum(vocabulary.scored[vocabulary.pieces[i]][0] for i in ids)
        assert score == pytest.approx(plain_best(word, vocabulary))


def test_prefixes_are_shared(vocabulary):
    words = {"▁inter" + s for s in ("", "n", "nal", "nation", "national")}
    nodes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert pieces.Encoder(vocabulary).learn(words) == len(nodes) < sum(map(len, words))


def test_round_trip_of_every_text(spark, both):
    coded = pieces.encode(both, ["doc_id", "text"]).withColumnRenamed("text", "given")
    back = pieces.decode(coded, ["doc_id", "given"]).collect()
    assert len(back) == both.count()
    assert all(r.text == (r.given or "") for r in back)


def test_query(spark, sf_dir, docs):
    rows = QUERIES["op5_sentencepiece_viterbi"](spark, sf_dir)
    assert rows.count() == docs.count() and rows.where("not round_trip").count() == 0


def test_empty_table_and_missing_ids(spark, no_docs):
    assert pieces.encode(no_docs, ["doc_id"]).count() == 0
    rows = spark.range(1).select("id", F.lit(None).cast("array<int>").alias("ids"))
    assert pieces.decode(rows, ["id"]).first().text is None
