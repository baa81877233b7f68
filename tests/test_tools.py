"""Each tool and verb gives the rows of what it is made of."""

import pytest
from pyspark.sql import functions as F

from folioflow.plans import fixtures as X
from folioflow.plans import tools

from .conftest import SMALL


@pytest.fixture(scope="module")
def first(spark):
    return X.corpus(spark, SMALL).where("ord = 7").first()


def test_lookups(spark, first):
    assert tools.TOOLS["getDocumentContent"](spark, SMALL, first.path).first().content == first.text
    assert tools.TOOLS["getDocumentContent"](spark, SMALL, first.name.upper(), width=10).first().content == first.text[:10] + "\n[truncated]"
    whole = tools.TOOLS["getDocumentContent"](spark, SMALL, first.path, page_range=f"1-{first.page_count}").first().content
    assert whole.replace("\n\n", "") == first.text.replace("\n\n", "")
    assert tools.TOOLS["listDocuments"](spark, SMALL).count() == X.corpus(spark, SMALL).count()
    pictures = tools.TOOLS["getDocumentImages"](spark, SMALL, first.path, 1).collect()
    assert {r.document_id for r in pictures} <= {first.document_id} and {r.page_number for r in pictures} <= {1}


def test_searches(spark, first):
    words = " ".join(first.text.split()[:8])
    for name in ("searchDocuments", "semanticSearch"):
        hits = tools.TOOLS[name](spark, SMALL, words, 3).collect()
        assert sorted(r["rank"] for r in hits) == [1, 2, 3]
    own = tools.VERBS[""](spark, SMALL, words, 3, document=first.name).collect()
    assert own and {r.document_id for r in own} == {first.document_id}
    assert tools.VERBS["/cited"](spark, SMALL, words, 2).first().context.startswith("[SOURCE 1] (")


def test_summaries_citations_and_highlights(spark, first):
    plain = tools.TOOLS["summarizeDocument"](spark, SMALL, first.path).first().content
    nowhere = tools.TOOLS["summarizeDocument"](spark, SMALL, first.path, section="qqqq").first().content
    assert plain and nowhere == plain
    report = tools.TOOLS["getCitations"](spark, SMALL, "smith").first()
    assert report.reference_total == 2 and len(report.references) == 2
    blue = tools.TOOLS["getHighlights"](spark, SMALL, color="blue").collect()
    assert len(blue) == 20 and {r.n for r in blue} == {X.highlights(spark, SMALL).where("color = 'blue'").count()}
    one = tools.TOOLS["getHighlights"](spark, SMALL, document=F.col("document_id") == 3).collect()
    assert {r.id for r in one} <= {r.id for r in X.highlights(spark, SMALL).where("document_id = 3").collect()}
    assert tools.VERBS["/stats"](spark, SMALL).first().documents == X.corpus(spark, SMALL).count()
    assert tools.VERBS["/list"](spark, SMALL).count() == X.corpus(spark, SMALL).count()
    assert tools.VERBS["/highlights"](spark, SMALL).count() > 0
