from .jobs import collect_comments, collect_corpus, collect_posts, evaluate, weak_label_job

__all__ = ["collect_comments", "collect_corpus", "collect_posts", "evaluate", "weak_label_job"]
