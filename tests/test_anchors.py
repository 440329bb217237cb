"""What F27 writes on the way."""

from seqloom.operators.domains import f27_arrays
from seqloom.plans.storage import Scratch


def test_no_sequence_is_written_or_joined(spark, sf, monkeypatch):
    written, write = [], Scratch.write

    def seen(self, df, name):
        written.extend(df.columns)
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", seen)
    assert f27_arrays(spark, sf).count() > 0
    assert "start" in written and "rna" not in written
