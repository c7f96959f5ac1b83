import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm import language
from tickerloom.llm.queries import QUERIES


def test_query_learns_from_training_rows_and_holds_up(spark, sf_dir, docs, both, monkeypatch):
    monkeypatch.setattr(language, "table", lambda *_: both)
    rows = QUERIES["op8_centroid_language"](spark, sf_dir).collect()
    assert len(rows) == both.count()
    given = {r.doc_id: r for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in given]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id)
    right = sum(r.lang_pred == given[r.doc_id].lang for r in held)
    assert len(held) > 40 and right >= 0.97 * len(held)
    assert not any(r.rejected for r in rows if r.doc_id in given)
    assert all(0 <= r.score <= 1 for r in rows)
    blank = {r.doc_id: r for r in rows}
    for i in (900001, 900002, 900003):
        assert (blank[i].lang_pred, blank[i].score, blank[i].rejected) == ("und", 0.0, True)


def test_label_and_id_are_no_inputs(spark, docs):
    model = language.fit(docs)
    one = language.predict(docs, model, ["doc_id"]).collect()
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    assert sorted(one) == sorted(language.predict(other, model, ["doc_id"]).collect())


def test_counts_do_not_depend_on_the_stretch(monkeypatch):
    text = "Été à la plage, 12 straßen — of the \U0001f600 world " * 20
    whole = language.counts(text)
    for chars in (5, 37, 64):
        monkeypatch.setattr(language, "CHARS", chars)
        assert np.array_equal(language.counts(text), whole)


def test_foreign_text_is_rejected(spark, docs):
    model = language.fit(docs)
    rows = spark.createDataFrame([(1, "これは日本語の文章です " * 30), (2, "42 %% !!")], "doc_id int, text string")
    found = language.predict(rows, model, ["doc_id"]).orderBy("doc_id").collect()
    assert all(r.rejected for r in found) and found[1].lang_pred == "und"


def test_nothing_to_learn_from(spark, no_docs, odd_docs):
    model = language.fit(no_docs)
    rows = language.predict(odd_docs, model, ["doc_id", "fingerprint"]).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows} == {"und"}
    assert language.predict(no_docs, model, ["doc_id"]).count() == 0


def test_stage(spark, both):
    out = language.language_stage(spark, both, "")
    assert out.columns == both.columns
    assert {r.doc_id for r in out.collect()}.isdisjoint({900001, 900002, 900003})


UNSEEN = [
    "La mattina presto il mercato della piazza si riempie di persone che cercano frutta fresca, verdura e "
    "pane appena sfornato. I venditori gridano i prezzi mentre i bambini corrono tra le bancarelle. ",
    "Varhain aamulla torilla on paljon ihmisiä, jotka etsivät tuoreita hedelmiä, vihanneksia ja leipää. "
    "Myyjät huutavat hintoja, lapset juoksevat kojujen välissä ja vanhukset keskustelevat säästä. ",
    "Sabahın erken saatlerinde pazar yeri taze meyve, sebze ve yeni pişmiş ekmek arayan insanlarla dolar. "
    "Satıcılar fiyatları bağırırken çocuklar tezgahların arasında koşar. ",
    "Wczesnym rankiem rynek wypełnia się ludźmi, którzy szukają świeżych owoców, warzyw i chleba. "
    "Sprzedawcy wykrzykują ceny, dzieci biegają między straganami, a starsi rozmawiają o pogodzie. ",
    "Sáng sớm, khu chợ đầy những người đi tìm trái cây tươi, rau và bánh mì vừa mới nướng. "
    "Người bán hàng rao giá, trẻ em chạy giữa các gian hàng và những người già nói chuyện. ",
]


def test_unseen_languages_and_gibberish_go_and_clean_texts_stay(spark, docs):
    rng = random.Random(5)
    letters = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя"]
    noise = [" ".join("".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(1000)) for a in letters]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit(docs.where(~held))
    rows = spark.createDataFrame([(i, 3 * t) for i, t in enumerate(UNSEEN)] + list(enumerate(noise, 10)), "doc_id int, text string")
    found = language.predict(rows, model, ["doc_id"]).collect()
    assert [r.doc_id for r in found if not r.rejected] == []
    assert language.predict(docs.where(held), model, ["doc_id"]).where("rejected").count() == 0
