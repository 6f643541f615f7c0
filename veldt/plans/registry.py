"""All registered queries of the engine and their SQL."""

from veldt.session import register

from . import opqueries, sqltexts, vech


def _sql(text: str):
    def run(spark, sf_dir):
        register(spark, sf_dir)
        return spark.sql(text)

    return run


QUERIES = opqueries.QUERIES | {k: _sql(v) for k, v in sqltexts.ALL.items()} | vech.QUERIES
ORACLE_SQL = opqueries.ORACLE_SQL | sqltexts.ALL | vech.ORACLE_SQL
