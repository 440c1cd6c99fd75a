import os
import sys
import tempfile
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from threadlens.sources.messages import MESSAGE_COLUMNS, MESSAGE_SCHEMA  # noqa: E402

AS_OF = datetime(2024, 4, 10, 9, 0, 0)


@pytest.fixture(scope="session")
def spark():
    from threadlens.session import local_session
    s = local_session(cores=4, partitions=4, extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="threadlens-test-ckpt-")})
    yield s
    s.stop()


def msg(mid, conv, t, sender="alice", body="", subject="Plan", folder="Inbox", item_class=43,
        address=None, cc=None, attachments=0):
    return {"message_id": mid, "conversation_id": conv, "folder": folder, "item_class": item_class,
            "sender": sender, "sender_address": address or (f"{sender}@example.com" if sender else None),
            "cc": cc, "subject": subject, "body": body, "received_time": t, "attachment_count": attachments}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in MESSAGE_COLUMNS) for r in rows], MESSAGE_SCHEMA)


def ago(days=0, hours=0, minutes=0):
    return AS_OF - timedelta(days=days, hours=hours, minutes=minutes)
