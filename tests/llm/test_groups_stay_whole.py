"""Groups that Python handles stay whole whatever adaptive execution makes of the joins before them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmura.llm import shared


def test_groups_are_dealt_after_a_join_by_their_keys(spark):
    """The join's own shuffle doesn't do: it is read locally once the join is broadcast."""
    rows = spark.range(0, 900, 1, 4).select((F.col("id") % 300).alias("k"), "id").hint("merge")
    sized = rows.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    size = pa.schema([("k", pa.int64()), ("held", pa.int64())])
    got = shared.by_group(sized, ["k"], lambda group: [np.array([group.column("k")[0].as_py()]), np.array([group.num_rows])], size)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index("MapInArrow") : plan.index("SortMergeJoin")]
    assert sorted(map(tuple, got.collect())) == [(k, 3) for k in range(300)]
