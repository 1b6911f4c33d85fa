"""Every registered query: a Spark callable over the given tables and, where SQL can say it, the same result in SQL."""
REGISTRY = {}


def query(name, sql=None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all():
    from importlib import import_module
    for module in ("analytics", "profiling", "whole_table", "people", "time_columns", "contact", "numeric", "categorical",
                   "organisation", "text", "medical", "records", "checks", "reports", "findings"):
        try:
            import_module(f"queries.{module}")
        except ModuleNotFoundError as e:
            if e.name != f"queries.{module}":
                raise
    return REGISTRY
