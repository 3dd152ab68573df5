"""One import surface: every inventory operator under its inventory name.

    from tidepool import api
    preds = api.score_mc(features, weights, passes=20)
    top = api.topk_cells(api.mask_unlabelled(api.acq_bald(preds), pool), k=10)
"""

from tidepool.operators.acquisition import (  # noqa: F401
    bald as acq_bald, epig as acq_epig, greedy as acq_greedy, random_index as acq_random_index,
    score_range_check, ucb as acq_ucb, uniform as acq_uniform, warn_on_bad_scores,
)
from tidepool.operators.cluster import similarity_clusters, split_by_cluster  # noqa: F401
from tidepool.operators.fingerprint import hash_fingerprint, quarantine_rows, quarantine_summary  # noqa: F401
from tidepool.operators.losses import (  # noqa: F401
    class_weights, focal_loss, focal_loss_v2, masked_bce, pos_neg_loss, pos_weights, target_weights, weighted_bce,
)
from tidepool.operators.metrics import (  # noqa: F401
    ace, aupr, average_precision, balanced_acc, best_f1, ece, f1_at_threshold, metrics_report, metrics_table,
    nanmean_metrics, pr_curve, roc_auc, roc_curve, sens_spec, threshold_curve, threshold_metrics,
)
from tidepool.operators.ranking import hash_rank, ordered_rank, prefix_sums  # noqa: F401
from tidepool.operators.reshape import (  # noqa: F401
    align_features, concat_features, dedup_keep_first, features_for_labels, labels_with_features, melt_labels,
    merge_cells, pack_features, select_tasks, select_tasks_long, to_dataset, to_wide, unpack_features,
)
from tidepool.operators.sampling import (  # noqa: F401
    remainder_pool, seed_set_any_active, seed_set_aux, seed_set_balanced, seed_sets_for_runs,
)
from tidepool.operators.scoring import (  # noqa: F401
    centroid_weights, explode_passes, labelled_predictions, pred_mean_var, score_deterministic, score_mc,
    score_mc_expr, train_surrogate,
)
from tidepool.operators.selection import (  # noqa: F401
    conservation_check, mask_unlabelled, reveal_cells, shrink_pool, shrink_pool_single, shrink_pool_wide,
    topk_cells, topk_one_task, upsert_train, upsert_train_wide,
)
from tidepool.operators.split import (  # noqa: F401
    fold_guard, kfold_multilabel, kfold_stratified, split_by_group, split_existing, split_multilabel, split_random,
    split_stratified,
)
from tidepool.plans.loop import (  # noqa: F401
    al_run, al_step, experiment_grid, iteration_done, iterations_done, replay_history,
)
from tidepool.plans.pipeline import active_learning_run, fingerprint_job  # noqa: F401
from tidepool.plans.runs import RunSpec, al_runs  # noqa: F401
from tidepool.sources.history import append_history, compact_history, read_history  # noqa: F401
from tidepool.sources.io import normalize_missing, read_features, read_table, write_table  # noqa: F401
