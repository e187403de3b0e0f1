"""Fixed values that decide results (times in minutes or seconds, pitch on a 0-100 grid)."""

MINUTES_PER_MATCH = 90
PLAYERS_PER_TEAM = 11
HALFTIME_MINUTE = 45

MIN_MINUTES_RIDGE = 90
MIN_MINUTES_BOXSCORE = 450
MIN_MINUTES_FEATURES = 180
MIN_GAMES_FOR_PADDING = 10
MIN_SHOTS_FOR_FINISHING = 20
MIN_WEIGHT_DURATION = 0.01

FINISHING_PRIOR = 5

TOUCHES_PER_SEQUENCE = 5
MIN_SEQUENCES_PER_MATCH = 20

XG_MIN = 0.01
XG_MAX = 0.75
PENALTY_XG = 0.76

CHAIN_TIME_GAP_SECONDS = 30

SIX_YARD_X_MIN = 94
SIX_YARD_Y_MIN = 37
SIX_YARD_Y_MAX = 63

BASE_PASSER_SHARE = 0.5
PASS_DIFFICULTY_ADJUSTMENT = 0.3
TURNOVER_BLAME_SHARE = 0.5
DEFENSIVE_BOOST = 1.5
POSITION_SCALE_MIN = 0.3
POSITION_RAMP_X = 40
FAILED_PASS_SCALE_MIN = 0.6
BACKWARD_PASS_PENALTY = 0.2

ELO_K = 20.0
ELO_HOME_ADVANTAGE = 65.0
ELO_INITIAL = 1500.0
