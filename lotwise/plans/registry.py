"""Registry of named queries and the SQL text that checks them."""
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir) -> DataFrame`` with its checking SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add
