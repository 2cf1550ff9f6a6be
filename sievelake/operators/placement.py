"""Which device will serve a model, from the device link's status and the list of loaded models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names for the machine itself.
LOCAL_NAMES = ("local", "this-machine", "this machine")
STATUS = "struct<deviceIdentifier: string, peers: array<struct<deviceName: string, deviceIdentifier: string, loadedModels: array<string>>>>"
LOADED = "array<struct<identifier: string, modelKey: string, deviceIdentifier: string>>"


def located(models: DataFrame, status: DataFrame, loaded: DataFrame) -> DataFrame:
    """model, placement (local, remote, ambiguous, undetermined), devices (remote ones that have it, in order).

    models: model; status: ord, device, device_id, model (a row for each model that a
    peer has loaded); loaded: identifier, model_key, device_id. Equi-joins only.
    """
    remote = status.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "device"))), lambda x: x["device"]).alias("devices"))
    here = loaded.where(F.coalesce("device_id", F.lit("")) == "")
    here = here.select(F.col("identifier").alias("model")).union(here.select("model_key")).where("model is not null").distinct().withColumn("here", F.lit(True))
    rows = models.join(remote, "model", "left").join(here, "model", "left")
    devices = F.coalesce("devices", F.array().cast("array<string>"))
    some, own = F.size(devices) > 0, F.coalesce("here", F.lit(False))
    return rows.select("model", F.when(some & own, "ambiguous").when(some, "remote").when(own, "local").otherwise("undetermined").alias("placement"), devices.alias("devices"))


def peers(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The status relation from the link's JSON."""
    each = payloads.select(F.posexplode(F.from_json(payload, STATUS)["peers"]).alias("ord", "p"))
    return each.select("ord", F.coalesce("p.deviceName", F.lit("unknown remote device")).alias("device"), F.coalesce("p.deviceIdentifier", F.lit("")).alias("device_id"), F.explode("p.loadedModels").alias("model"))


def loaded_models(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    each = payloads.select(F.explode(F.from_json(payload, LOADED)).alias("m"))
    return each.select(F.col("m.identifier").alias("identifier"), F.col("m.modelKey").alias("model_key"), F.col("m.deviceIdentifier").alias("device_id"))


def matches(label: Column, device: Column) -> Column:
    """Whether a candidate's label answers to the device asked for."""
    want, have = F.lower(F.btrim(device)), F.lower(label)
    return F.when(want.isin(*LOCAL_NAMES), have.contains("local")).otherwise(have.contains(want))


def chosen(candidates: DataFrame, wishes: DataFrame, key: str) -> DataFrame:
    """key, label: the first candidate (by ord) of each key that answers to its wish, or null."""
    rows = wishes.join(candidates, key, "left")
    fits = matches(F.col("label"), F.col("device"))
    return rows.groupBy(key).agg(F.min_by(F.when(fits, F.col("label")), F.when(fits, F.col("ord"))).alias("label"))


def gate(placement: Column, provider: Column, model: Column, force: Column, device: Column) -> Column:
    """What a run does without asking: proceed, choose (a device was named) or skip."""
    free = (provider != "lm_studio") | (F.coalesce(model, F.lit("")) == "")
    return F.when(free | (placement == "remote") | force, "proceed").when((placement == "ambiguous") & device.isNotNull(), "choose").otherwise("skip")
