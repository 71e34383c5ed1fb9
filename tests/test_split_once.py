"""The classifier's passes read a written split and hash no key again."""

from ordertide.operators import supervised as SU
from ordertide.sources.sales import sales_view
from tests.conftest import SF_SMALL


def test_classifier_hashes_keys_once(spark, monkeypatch):
    seen, plain = [], SU.fit_features

    def spied(train, *rest, **options):
        seen.append("md5" in train._jdf.queryExecution().optimizedPlan().toString())
        return plain(train, *rest, **options)

    monkeypatch.setattr(SU, "fit_features", spied)
    out = SU.fit_classifier(sales_view(spark, SF_SMALL))
    assert seen == [False]
    assert "md5" not in out["predictions"]._jdf.queryExecution().optimizedPlan().toString()
