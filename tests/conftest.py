import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tillview.session import build_session

    session = build_session(
        "tillview-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    """Build a small fact: rows of (transaction_id, user_id, product_id, time, quantity, amount)."""

    def build(rows):
        return spark.createDataFrame(
            [(*r[:5], None if r[5] is None else float(r[5])) for r in rows],
            "transaction_id bigint, user_id bigint, product_id bigint, transaction_date string, quantity bigint, "
            "total_amount double",
        ).selectExpr(
            "transaction_id",
            "user_id",
            "product_id",
            "concat('s', transaction_id) AS session_id",
            "CAST(transaction_date AS TIMESTAMP_NTZ) AS transaction_date",
            "quantity",
            "CAST(total_amount AS DECIMAL(12,2)) AS total_amount",
            "CAST(0 AS DECIMAL(12,2)) AS discount_amount",
        )

    return build
