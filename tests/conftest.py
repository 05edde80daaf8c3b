import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packetloom.session import build_session  # noqa: E402
from packetloom.store import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=4, spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def store(spark):
    return Store(spark)


@pytest.fixture(scope="session")
def make_packets(spark):
    """Rows of (t, src, dst[, bytes, label, port, protocol]) as packets."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            t, src, dst = r[:3]
            size, label, port, protocol = (list(r[3:]) + [100, 0, 80, 6][len(r) - 3 :])[:4]
            full.append((i, float(t), src, dst, 1000 + i % 3, port, protocol, size, size + 42, label))
        return spark.createDataFrame(
            full,
            "packet_index long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int,"
            " protocol int, payload_length int, packet_length int, label int",
        )

    return build
