"""Plans as text, for tests that look at what Spark ran."""


def plan(df):
    """Executed (final) plan text; the query must have run on this very DataFrame."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode).split("== Initial Plan ==")[0]
