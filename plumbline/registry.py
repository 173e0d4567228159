"""Where queries and their oracles register."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a query, and its DuckDB oracle where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put
