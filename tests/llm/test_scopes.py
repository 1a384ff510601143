"""Tables of a scope are deleted by it alone, also while other threads have scopes open."""

import threading

from millrace.llm import common


def test_scopes_of_threads_do_not_meet(spark):
    ready, done, kept = threading.Event(), threading.Event(), {}

    def other():
        with common.scratch():
            kept["other"] = common.materialize(spark.range(3), "other")
            ready.set()
            done.wait(60)
            kept["count"] = kept["other"].count()

    t = threading.Thread(target=other)
    with common.scratch():
        mine = common.materialize(spark.range(5), "mine")
        t.start()
        ready.wait(60)
        with common.scratch():
            inner = common.materialize(spark.range(7), "inner", keep=True)
        assert mine.count() == 5 and inner.count() == 7
    done.set()
    t.join()
    assert kept["count"] == 3
