from .intake import Intake, take_in, take_in_comments, take_in_posts, take_in_responses
from .tables import (
    export_clean,
    read_comments,
    read_examples_csv,
    read_posts,
    read_responses,
    read_table,
    write_examples_csv,
    write_results_json,
)

__all__ = [
    "Intake", "take_in", "take_in_comments", "take_in_posts", "take_in_responses",
    "export_clean", "read_comments", "read_examples_csv", "read_posts", "read_responses",
    "read_table", "write_examples_csv", "write_results_json",
]
