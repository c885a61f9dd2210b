from .streams import (
    dedupe_stream,
    label_counts_stream,
    label_stream,
    late_counts,
    predict_stream,
    read_stage,
    read_stream,
    run_available,
    run_once,
    split_late,
    thin_stream,
)

__all__ = [
    "dedupe_stream", "label_counts_stream", "label_stream", "late_counts", "predict_stream",
    "read_stage", "read_stream", "run_available", "run_once", "split_late", "thin_stream",
]
