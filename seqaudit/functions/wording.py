"""Sentences that results must word exactly so."""

# Reasons, warnings and limitations, by their first words, in order of use.
SAYS = {
    "test_rows": "test rows ",
    "required": " < required ",
    "split_quality_warning_flagged_as": "split quality warning flagged as DO NOT TRUST",
    "model_training_independence_is_unverified": "model-training independence is unverified",
    "external_predictions_were_not_declared": "external predictions were not declared as generated on a verified locked holdout",
    "cross_split_violation": "cross-split violation: ",
    "model_metric_is_missing": "model metric is missing",
    "baseline_metric_is_missing": "baseline metric is missing",
    "leakage_gate_failed": "leakage gate failed",
    "lift_delta": "lift delta ",
    "lift_delta_95_ci_lower": "lift delta 95% CI lower bound ",
    "uncertainty_type_is_none": "uncertainty_type is 'none'",
    "uncertainty_audit_is_not_available": "uncertainty audit is not available",
    "uncertainty_error_spearman": "uncertainty/error spearman ",
    "absolute_error_scale_metrics_are": "absolute-error scale metrics are missing",
    "absolute_error_scale_gap_ratio": "absolute-error scale gap ratio ",
    "is_not_dimensionally_evaluable_by": "' is not dimensionally evaluable by this audit",
    "candidate_biological_synthesis_constraints_were": "candidate biological/synthesis constraints were not verified",
    "no_candidate_prioritization_rows_were": "no candidate-prioritization rows were produced",
    "severe_warning_present": "severe warning present",
    "leakage_check_did_not_meet": "leakage check did not meet the selected policy",
    "lift_check_did_not_meet": "lift check did not meet the selected policy",
    "uncertainty_usability_check_did_not": "uncertainty usability check did not meet the selected policy",
    "candidate_constraints_were_not_verified": "candidate constraints were not verified",
    "model_training_data_split_and": "model, training-data, split, and code hashes are not all present",
    "the_evaluation_remains_retrospective_unless": "the evaluation remains retrospective unless a prospective protocol is supplied",
    "the_supplied_provenance_does_not": "the supplied provenance does not declare a verified locked holdout",
    "independence_from_model_training_data": "independence from model training data was not independently verified",
    "a_prospective_protocol_was_supplied": "a prospective protocol was supplied, but its selection/outcome artifacts were not verified",
    "the_internal_training_workflow_cannot": "the internal training workflow cannot establish that model-based selection preceded these outcomes",
    "the_external_model_was_not": "the external model was not executed here against a locked test set",
    "prospective_biological_utility_has_not": "prospective biological utility has not been demonstrated",
    "performance_was_measured_after_a": "performance was measured after a hashed, timestamped candidate selection",
    "the_locked_holdout_declaration_and": "the locked-holdout declaration and complete provenance hashes cap this at holdout evidence",
    "model_fitting_splitting_and_retrospective": "model fitting, splitting, and retrospective evaluation ran in one controlled execution",
    "the_selected_leakage_checks_met": "the selected leakage checks met their declared thresholds",
    "the_model_beat_the_tested": "the model beat the tested simple baselines under the declared lift policy",
    "the_conclusion_did_not_change": "the conclusion did not change under the included stricter threshold profiles",
    "no_usable_held_out_primary": "no usable held-out primary metric was produced",
    "one_or_more_retrospective_leakage": "one or more retrospective leakage/lift checks did not meet the selected policy",
    "conclusion_sensitivity_to_alternate_similarity": "conclusion sensitivity to alternate similarity settings was not evaluated",
    "the_conclusion_is_sensitive_to": "the conclusion is sensitive to stricter thresholds or similarity settings",
    "self_declared_or_incomplete_provenance": "self-declared or incomplete provenance caps the result at descriptive evidence",
    "retrospective_performance_does_not_establish": "retrospective performance does not establish wet-lab value",
    "held_out_rows_were_available": " held-out rows were available; the declared minimum is ",
    "leakage_independence_checks_did_not": "leakage/independence checks did not pass",
    "model_lift_did_not_pass": "model lift did not pass",
    "biological_and_synthesis_constraints_were": "biological and synthesis constraints were not verified",
    "uncertainty_semantics_were_not_declared": "uncertainty semantics were not declared",
    "measurement_does_not_follow_the": "measurement does not follow the selection",
    "do_not_trust_only": "DO NOT TRUST: only ",
    "labeled_rows_passed_validation_use": " labeled rows passed validation; use this as a data audit or pilot benchmark until validation performance is strong.",
    "group_column": "Group column '",
    "has_fewer_than_2_groups": "' has fewer than 2 groups after validation.",
    "is_imbalanced_largest_group_contains": "' is imbalanced; largest group contains ",
    "of_accepted_rows": "% of accepted rows.",
    "no_candidates_satisfied_the_configured": "no candidates satisfied the configured constraints",
    "some_plate_capacity_was_unused": "some plate capacity was unused because candidates failed quotas or budget constraints",
    "do_not_trust_fewer_than": "DO NOT TRUST: fewer than 3 leakage-safe clusters are available; validation/test splits may be empty.",
    "do_not_trust_requested_leakage": "DO NOT TRUST: requested leakage-safe ",
    "split_is_empty_collect_more": " split is empty; collect more independent groups.",
}
