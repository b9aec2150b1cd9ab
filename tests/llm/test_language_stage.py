import random

from graphloom.llm import language_id

from .conftest import SF

FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun väriin sukupuoleen kieleen uskontoon poliittiseen tai muuhun mielipiteeseen kansalliseen tai yhteiskunnalliseen alkuperään omaisuuteen syntyperään tai muuhun tekijään perustuvaa erotusta"
RUSSIAN = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства "


def test_stage_drops_what_is_in_no_learnt_language(spark, small):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    odd = [FINNISH, RUSSIAN * 3, noise(60), noise(600), noise(6_000), "0 1 2 " * 30]
    planted = spark.createDataFrame([(10**6 + i, t, None if i % 2 else "en", "s", len(t)) for i, t in enumerate(odd)], small.schema)
    clean = small.where("lang is not null and size(split(text, ' ')) >= 50")
    stay = [r["doc_id"] for r in language_id.language_stage(spark, clean.unionByName(planted), SF).collect()]
    assert not [k for k in stay if k >= 10**6]
    assert sorted(stay) == sorted(r["doc_id"] for r in clean.select("doc_id").collect())
