"""The opN_<name> queries of this subpackage and the SQL that checks them."""

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
