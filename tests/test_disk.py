"""What queries hold on disk."""

import os

from ordertide.operators import supervised as SU
from ordertide.plans import catalog
from ordertide.session import ensure_checkpoint_dir, reliable_checkpoint
from ordertide.sources.sales import sales_view
from ordertide.sources.sinks import write_result
from tests.conftest import SF_SMALL


def files(top: str) -> dict[str, int]:
    top = top.removeprefix("file:")
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names}


def shuffled(spark) -> int:
    """Shuffle files on the driver's disk (a local session has no other)."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum("/shuffle_" in f and f.endswith(".data") for d in dirs for f in files(d))


def test_classifier_writes_its_rows_once(spark, monkeypatch):
    """Labels, hashes and the split are no further tables beside the rows, which go when the fit is done."""
    top = ensure_checkpoint_dir(spark)
    before, held, plain = files(top), [], SU.fit_features

    def spied(train, *rest, **options):
        held.append(sum(size for f, size in files(top).items() if f not in before) / sales_view(spark, SF_SMALL).count())
        return plain(train, *rest, **options)

    monkeypatch.setattr(SU, "fit_features", spied)
    out = SU.fit_classifier(sales_view(spark, SF_SMALL))
    assert held[0] < 60  # bytes a row
    assert not [f for f in files(top) if "classifier-rows" in f and f not in before]
    assert out["predictions"].count() == 1500 and out["summary"].count() == 1


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    rows = spark.range(1000).repartition(3, "id")
    before = shuffled(spark)
    kept = reliable_checkpoint(rows)
    write_result(rows, str(tmp_path / "rows"), "json")
    assert shuffled(spark) <= before
    assert kept.count() == spark.read.json(str(tmp_path / "rows")).count() == rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_text_lines_are_compressed(spark):
    top = ensure_checkpoint_dir(spark)
    before = files(top)
    for fmt in ("csv", "json"):
        n = catalog.REGISTRY[f"read_sales_{fmt}"].fn(spark, SF_SMALL).count()
        text = {f: size for f, size in files(top).items() if f not in before and f"order-lines-{fmt}" in f and "/part-" in f}
        assert text and all(f.endswith(f".{fmt}.gz") for f in text) and sum(text.values()) < 50 * n
