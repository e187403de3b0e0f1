"""Pitch geometry on a 0-100 grid; the attacked goal lies at x = 100, y = 50."""

from pyspark.sql import Column, functions as F

from touchline.constants import XG_MAX, XG_MIN
from touchline.functions.numeric import clamp, col, flag


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def distance_to_goal(x, y, goal_x=100.0, goal_y=50.0) -> Column:
    return distance(x, y, F.lit(goal_x), F.lit(goal_y))


def angle_to_goal(x, y, goal_width=12.0) -> Column:
    """Angle between the posts as seen from (x, y)."""
    depth = F.greatest(F.lit(100.0) - col(x), F.lit(0.1))
    near = F.atan2(F.lit(50.0 - goal_width / 2) - col(y), depth)
    far = F.atan2(F.lit(50.0 + goal_width / 2) - col(y), depth)
    return F.abs(far - near)


def third_index(v) -> Column:
    """0, 1 or 2 by equal thirds of the pitch."""
    return clamp(F.floor(col(v) / F.lit(33.34)), 0, 2)


def zone_id(x, y) -> Column:
    return (third_index(x) * 3 + third_index(y) + 1).cast("int")


def pitch_zone(x, y) -> Column:
    """Zone 1-9 with cuts at 33 and 67, upper bounds inside."""
    third = lambda v: F.when(col(v) <= 33, 0).when(col(v) <= 67, 1).otherwise(2)
    known = col(x).isNotNull() & col(y).isNotNull()
    return F.when(known, third(x) * 3 + third(y) + 1)


def in_penalty_area(x, y, attacking=True) -> Column:
    deep = col(x) > 83 if attacking else col(x) < 17
    return deep & (col(y) > 21) & (col(y) < 79)


def in_final_third(x, attacking=True) -> Column:
    return col(x) > 67 if attacking else col(x) < 33


def location_features(x, y) -> dict[str, Column]:
    x, y = col(x), col(y)
    return {
        "x": x,
        "y": y,
        "distance_to_goal": distance_to_goal(x, y),
        "angle_to_goal": angle_to_goal(x, y),
        "zone_id": zone_id(x, y),
        "in_penalty_area": flag(in_penalty_area(x, y)),
        "in_final_third": flag(x > 67),
        "in_own_third": flag(x < 33),
        "in_mid_third": flag((x >= 33) & (x < 67)),
        "y_left": flag(y < 33),
        "y_center": flag((y >= 33) & (y < 67)),
        "y_right": flag(y >= 67),
    }


def simple_xg(x, y) -> Column:
    """Closed-form scoring chance from distance and goal angle."""
    x, y = col(x), col(y)
    angle = F.abs(F.atan2(y - 44, 100 - x) - F.atan2(y - 56, 100 - x))
    logit = F.lit(-2.8) - F.lit(0.12) * distance_to_goal(x, y) + F.lit(3.0) * angle
    return clamp(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), XG_MIN, XG_MAX)
