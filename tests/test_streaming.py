import datetime

from kinledger.ledger.model import TRANSACTIONS
from kinledger.streaming.journal import hourly_volume, read_journal, running_balances

T = datetime.datetime(2024, 5, 1, 10)


def test_balances_follow_the_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    first = [("1", "a", None, "ann", 0, 100, "", T), ("2", "a", "ann", "bob", 30, 30, "", T + datetime.timedelta(minutes=5))]
    again = [("2", "a", "ann", "bob", 30, 30, "", T + datetime.timedelta(minutes=5)), ("3", "a", "bob", None, 10, 0, "", T + datetime.timedelta(hours=3))]
    for rows in (first, again):
        spark.createDataFrame(rows, TRANSACTIONS).coalesce(1).write.mode("append").parquet(path)
    stream = read_journal(spark, path, files_per_trigger=1)
    for df, mode, name in ((running_balances(stream), "complete", "balances"), (hourly_volume(stream), "append", "volume")):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.owner: r.balance for r in spark.table("balances").collect()} == {"ann": 70, "bob": 20}
    assert [(r.hour, r.n) for r in spark.table("volume").collect()] == [(T, 2)]
