"""Settings: environment, message-source options, topic and job specifications."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

_MISSING = object()


def setting(name: str, default=_MISSING, kind=str, env=os.environ):
    """An environment setting as str, int, bool or parsed JSON (kind=list or dict)."""
    raw = env.get(name, "")
    if raw == "":
        if default is _MISSING:
            raise KeyError(f"{name} is not set")
        return default
    if kind is bool:
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if kind in (list, dict):
        value = json.loads(raw)
        if not isinstance(value, kind):
            raise ValueError(f"{name} must hold a JSON {kind.__name__}")
        return value
    return kind(raw)


def _local(servers: str) -> bool:
    return all(s.strip().split(":")[0] in ("localhost", "127.0.0.1", "broker", "kafka") for s in servers.split(","))


def source_options(servers: str, protocol: str = "SASL_SSL", mechanism: str = "PLAIN", user: str = "", secret: str = "", starting: str | dict = "earliest", most_rows: int | None = None, least_rows: int | None = None, most_seconds: int | None = None) -> dict[str, str]:
    """Options of Spark's message source. Authenticated protocols need credentials. A
    batch has most_rows at most, and waits for least_rows, but for most_seconds only."""
    out = {"kafka.bootstrap.servers": servers, "kafka.security.protocol": protocol, "failOnDataLoss": "false", "startingOffsets": json.dumps(starting) if isinstance(starting, dict) else starting}
    bounds = {"maxOffsetsPerTrigger": most_rows, "minOffsetsPerTrigger": least_rows, "maxTriggerDelay": f"{most_seconds}s" if most_seconds else None}
    out |= {k: str(v) for k, v in bounds.items() if v is not None}
    if protocol.startswith("SASL"):
        if not user or not secret:
            raise ValueError(f"{protocol} needs a user and a secret")
        out["kafka.sasl.mechanism"] = mechanism
        out["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{user}" password="{secret}";'
    return out


def client_security(servers: str, env=os.environ) -> tuple[dict[str, str], list[str]]:
    """(client settings, warnings); authenticated unless told otherwise."""
    protocol = setting("MESSAGE_SECURITY_PROTOCOL", "SASL_SSL", env=env)
    out, warnings = {"security.protocol": protocol}, []
    if protocol.startswith("SASL"):
        user, secret = setting("MESSAGE_USER", "", env=env), setting("MESSAGE_SECRET", "", env=env)
        if not user or not secret:
            raise ValueError(f"{protocol} needs MESSAGE_USER and MESSAGE_SECRET")
        out |= {"sasl.mechanism": setting("MESSAGE_MECHANISM", "PLAIN", env=env), "sasl.username": user, "sasl.password": secret}
    elif protocol == "PLAINTEXT" and not _local(servers):
        warnings.append(f"plaintext to {servers}")
    return out, warnings


def raw_paths(root: str, prefix: str, topic: str) -> dict[str, str]:
    base = "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((root, prefix)) if x)
    return {kind: f"{base}/{kind}/{topic}" for kind in ("data", "checkpoint", "quarantine")}


@dataclass(frozen=True)
class TopicSpec:
    topic: str
    subject: str
    starting_offsets: str | dict = "earliest"
    reader_schema: str = "latest"
    trigger_seconds: int = 30


@dataclass(frozen=True)
class EntitySpec:
    """A conformed table: where it comes from, its keys, and how it changes."""

    name: str
    source: str
    target: str
    keys: tuple[str, ...]
    order_column: str = "_kafka_timestamp_ms"
    ties: tuple[str, ...] = ("_kafka_offset",)
    required: tuple[str, ...] = ()
    history: int = 1
    quarantine: str = ""
    trigger_seconds: int = 60
    masking: tuple[dict, ...] = field(default_factory=tuple)


def _fields(raw: dict, needed: tuple[str, ...], what: str) -> None:
    missing = sorted(set(needed) - set(raw))
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")


def topic_specs(raw: list[dict]) -> list[TopicSpec]:
    out = []
    for x in raw:
        _fields(x, ("topic", "subject"), "topic spec")
        if x.get("reader_schema", "latest") != "latest":
            raise NotImplementedError(f"reader schema {x['reader_schema']}: only latest is known")
        out.append(TopicSpec(**{k: v for k, v in x.items() if k in TopicSpec.__dataclass_fields__}))
    return out


def entity_specs(raw: list[dict]) -> list[EntitySpec]:
    out = []
    for x in raw:
        _fields(x, ("name", "source", "target", "keys"), "entity spec")
        if x.get("history", 1) not in (1, 2):
            raise ValueError(f"history of type {x['history']}: 1 or 2")
        if not x["keys"]:
            raise ValueError(f"{x['name']} has no keys")
        x = x | {k: tuple(x[k]) for k in ("keys", "required", "ties", "masking") if k in x}
        out.append(EntitySpec(**{k: v for k, v in x.items() if k in EntitySpec.__dataclass_fields__}))
    return out


@dataclass(frozen=True)
class MaintenanceSpec:
    """What is done to a table at night: clustered by z_order or joined up (only files
    whose partitions meet `where`), and old files removed after `vacuum_hours` (0: kept)."""

    path: str
    z_order: tuple[str, ...] = ()
    where: str = ""
    target_mb: int = 1024
    vacuum_hours: int = 168


def maintenance_specs(raw: list[dict] | None = None, env=os.environ) -> list[MaintenanceSpec]:
    """From a list, or from the JSON list in LODESTRATA_MAINTENANCE."""
    out = []
    for x in setting("LODESTRATA_MAINTENANCE", kind=list, env=env) if raw is None else raw:
        _fields(x, ("path",), "maintenance spec")
        if unknown := sorted(set(x) - set(MaintenanceSpec.__dataclass_fields__)):
            raise ValueError(f"maintenance spec has unknown {', '.join(unknown)}")
        out.append(MaintenanceSpec(**x | ({"z_order": tuple(x["z_order"])} if "z_order" in x else {})))
    return out
