"""Tables of one caller outlive the clearing up of another."""

import threading


def test_settled_deletes_only_its_own_scope(spark):
    from ledgerleaf.llm.staging import scope, settled, staged

    before, opened, made = staged(spark.range(3), "before"), threading.Event(), threading.Event()
    others = []

    def other():
        opened.wait()
        others.append(staged(spark.range(5), "other"))
        with scope():
            others.append(staged(spark.range(6), "other"))
        made.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scope() as outer:
        with scope() as own:
            inner = staged(spark.range(4), "inner")
            opened.set()
            made.wait()
            out = settled(inner, "out", own)
        assert outer == [out._staged_path]
        kept = settled(out, "kept", outer)
    thread.join()
    assert [t.count() for t in (before, *others, kept)] == [3, 5, 6, 4]
    for gone in (inner, out):
        assert not spark._jvm.java.io.File(gone._staged_path.removeprefix("file:")).exists()
