"""What a query sends through shuffles, by Spark's own counts."""


def shuffled(spark, run) -> tuple[int, int]:
    """(rows, bytes) that stages write to shuffles while ``run`` is called."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    none = context._gateway.new_array(context._jvm.double, 0)

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        each = [stages.apply(k) for k in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)

    before = total()
    run()
    after = total()
    return after[0] - before[0], after[1] - before[1]
