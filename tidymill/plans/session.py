"""Session settings the library is tuned for. On a cluster the submitter's own settings win; nothing here is required."""
from pyspark.sql import SparkSession


def local_session(name="tidymill", cpus="*", partitions=8, memory="8g"):
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())
