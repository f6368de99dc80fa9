import hashlib

import pytest
from pyspark.sql import SparkSession

from certloom import schemas
from certloom.session import SETTINGS


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("certloom-tests")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Certs:
    """Certificate rows with defaults; every field can be set."""

    def __init__(self, spark):
        self.spark = spark
        self.n = 0

    def row(self, **fields):
        self.n += 1
        host = f"host-{self.n}.example.com"
        made = {"seen_at": 1_650_000_000, "domains": [host], "subject_cn": host, "cert_index": self.n, **fields}
        made.setdefault("fingerprint", hashlib.md5(b"%d" % self.n).hexdigest())
        made.setdefault("domain_count", len(made["domains"] or []))
        made.setdefault("created_at", made["seen_at"] + 60)
        rest = {"issuer_org": "Oak Trust", "issuer_cn": "Oak Trust R2", "log_name": "elm", "log_url": "https://elm.invalid/"}
        lifetime = {"not_before": 1_640_995_200, "not_after": 1_672_531_199}
        links = {"serial_number": f"0x{self.n:x}", "cert_link": f"https://elm.invalid/{self.n}"}
        return {**rest, **lifetime, **links, **made}

    def frame(self, *rows):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        from certloom.functions.times import seen_date

        schema = T.StructType([f for f in schemas.CERTIFICATE if f.name != "seen_date"])
        made = [self.row(**r) for r in rows]
        df = self.spark.createDataFrame([tuple(r[n] for n in schema.fieldNames()) for r in made], schema)
        return df.withColumn("seen_date", seen_date(F.col("seen_at")))


@pytest.fixture
def certs(spark):
    return Certs(spark)
