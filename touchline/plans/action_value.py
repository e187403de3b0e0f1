"""Whole flow: raw events to player action values."""

from pyspark.sql import DataFrame

from touchline.operators import actions as A, chains as C, credit as K, shots as S, value as V
from touchline.operators.boosting import BoostedModel
from touchline.operators.ordering import hot_groups
from touchline.operators.passes import add_xpass
from touchline.session import cut_lineage


def labelled_stream(events: DataFrame) -> DataFrame:
    """Actions with chains, chain outcomes, next-goal labels and features.

    Hot matches are found once on the raw events; all steps then share one layout by match.
    """
    hot = hot_groups(events, ("match_id",))
    actions = cut_lineage(A.to_actions(events, hot=hot))
    chained = C.possession_chains(actions, hot=hot)
    outcomes = C.with_next_chain_goal(C.chain_outcomes(chained), hot=hot)
    labelled = V.next_goal_labels(C.label_actions(chained, outcomes), hot=hot)
    return V.action_features(labelled, hot=hot)


def player_action_values(
    events: DataFrame,
    value_model: BoostedModel,
    lineups: DataFrame | None = None,
    xg_model: BoostedModel | None = None,
    xpass_model: BoostedModel | None = None,
    min_minutes: float = 450,
) -> DataFrame:
    """Player values with fitted models."""
    hot = hot_groups(events, ("match_id",))
    stream = V.predict_values(value_model, labelled_stream(events))
    if xg_model is not None:
        stream = S.add_xg(stream, xg_model)
    if xpass_model is not None:
        stream = add_xpass(stream, xpass_model)
    valued = V.action_values(cut_lineage(stream), value_model.metadata.get("method", "goal"), hot=hot)
    return K.player_values(K.assign_credit(valued, hot=hot), lineups, min_minutes)
