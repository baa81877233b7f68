"""Operators leave the session as it was, whatever runs before or after them."""

import pytest

from folioflow.llm import registry

DATA = "/root/testdata/sf0.001"
READ_ONLY = ("spark.app.", "spark.driver.port", "spark.checkpoint")


@pytest.mark.parametrize("name", ["op1_quality", "op5_sentencepiece", "op8_ngram_join", "op11_substring_dedup", "op13_source_divergence"])
def test_settings_are_as_before(spark, name):
    before = dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll()))
    registry.QUERIES[name](spark, DATA).count()
    after = dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll()))
    assert {k: v for k, v in after.items() if not k.startswith(READ_ONLY)} == {k: v for k, v in before.items() if not k.startswith(READ_ONLY)}
