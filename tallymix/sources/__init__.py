from tallymix.sources.tables import (  # noqa: F401
    counts_from_events,
    load_model,
    read_counts,
    read_feature_list,
    read_labels,
    read_ordination,
    save_model,
    save_trials,
    tip_rows,
    tree_tips,
    validate_counts,
)
