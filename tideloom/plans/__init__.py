from .config import DEFAULTS, IngestConfig
from .pipeline import IngestResult, ingest_batch, ingest_frame, ingest_messages
from .registry import activation_state, effective_config, prepare_jobs, register_jobs, reject_runs, resolve_runs

__all__ = [
    "DEFAULTS",
    "IngestConfig",
    "IngestResult",
    "activation_state",
    "effective_config",
    "ingest_batch",
    "ingest_frame",
    "ingest_messages",
    "prepare_jobs",
    "register_jobs",
    "reject_runs",
    "resolve_runs",
]
