"""Fixed values of the baseball configuration: event codes, weights, features."""

# --- fixed values: codes that do not end a plate appearance -----------------
NOT_PLATE_APPEARANCE = [
    "caught_stealing_3b", "caught_stealing_2b", "pickoff_caught_stealing_2b", "pickoff_2b",
    "pickoff_caught_stealing_3b", "pickoff_1b", "wild_pitch", "game_advisory",
    "caught_stealing_home", "pickoff_3b", "stolen_base_2b", "stolen_base_3b",
    "passed_ball", "pickoff_caught_stealing_home", "pickoff_error_3b",
]

# --- fixed values: event classes --------------------------------------------
HITS = ["single", "double", "triple", "home_run"]
AT_BATS = [
    "single", "double", "triple", "home_run", "field_out", "strikeout", "field_error",
    "force_out", "grounded_into_double_play", "fielders_choice", "other_out",
    "strikeout_double_play", "fielders_choice_out", "double_play", "sac_fly_double_play",
    "triple_play", "sac_bunt_double_play",
]
PITCHER_STRIKEOUTS = ["strikeout", "strikeout_double_play"]

# --- fixed values: outs made on the last pitch of an appearance -------------
SINGLE_OUTS = [
    "caught_stealing_home", "pickoff_3b", "pickoff_1b", "pickoff_caught_stealing_3b",
    "pickoff_caught_stealing_2b", "fielders_choice_out", "other_out", "sac_bunt", "sac_fly",
    "force_out", "caught_stealing_3b", "strikeout",
]
DOUBLE_OUTS = ["grounded_into_double_play", "strikeout_double_play", "double_play", "sac_bunt_double_play"]
TRIPLE_OUTS = ["triple_play"]
# a drop in the outs counter means an inning ended: -1 stands for 2 outs, -2 for 1
OUTS_WRAP = {-1: 2, -2: 1}

# --- fixed values: pitch measures averaged per pitch type -------------------
# output name -> input column
GAME_MEANS = {
    "release_speed": "release_speed", "release_x": "release_pos_x", "release_y": "release_pos_y",
    "release_z": "release_pos_z", "zone": "zone", "movement_horiz": "pfx_x",
    "movement_vert": "pfx_z", "plate_pos_horiz": "plate_x", "plate_pos_vert": "plate_z",
    "velocity_x": "vx0", "velocity_y": "vy0", "velocity_z": "vz0", "accel_x": "ax",
    "accel_y": "ay", "accel_z": "az", "launch_angle": "launch_angle",
    "launch_speed": "launch_speed", "effective_speed": "effective_speed",
    "spin_rate": "release_spin_rate", "extension": "release_extension",
    "estimated_BA": "estimated_ba_using_speedangle",
    "estimated_wOBA": "estimated_woba_using_speedangle", "wOBA_value": "woba_value",
    "BABIP_value": "babip_value", "ISO_value": "iso_value", "sp": "sp_indicator", "rp": "rp_indicator",
}
# output name -> (input column, counted value)
GAME_COUNTERS = {
    "strikes": ("type", "S"), "balls": ("type", "B"), "line_drives": ("bb_type", "line_drive"),
    "fly_balls": ("bb_type", "fly_ball"), "ground_balls": ("bb_type", "ground_ball"),
    "popups": ("bb_type", "popup"), "weak_contact": ("launch_speed_angle", 1),
    "topped_contact": ("launch_speed_angle", 2), "under_contact": ("launch_speed_angle", 3),
    "burner_contact": ("launch_speed_angle", 4), "solid_contact": ("launch_speed_angle", 5),
    "barreled_contact": ("launch_speed_angle", 6),
}
PITCHES_THROWN = ["strikes", "balls", "line_drives", "fly_balls", "ground_balls", "popups"]
SEASON_MEANS = [
    "release_speed", "zone", "movement_horiz", "movement_vert", "velocity_x", "velocity_y",
    "velocity_z", "accel_x", "accel_y", "accel_z", "launch_angle", "launch_speed",
    "effective_speed", "spin_rate", "wOBA_value", "BABIP_value", "ISO_value", "sp", "rp",
]

# --- fixed values: weights of past seasons ----------------------------------
SEASON_WEIGHTS = (0.1, 0.3, 0.6)
COUNTING = ((0.2, 0.3, 0.5), (0.4, 0.6))
CONTACT = ((0.15, 0.25, 0.6), (0.3, 0.7))
POWER = ((0.1, 0.2, 0.7), (0.2, 0.8))
HITTER_WEIGHTS = {
    "TB": COUNTING, "weighted_spot_avg": COUNTING,
    "K_perc": CONTACT, "Contact_perc": CONTACT, "RC_per_PA": CONTACT,
    "SF": POWER, "OPS": POWER, "BB_perc": POWER, "XBH_perc": POWER,
}
PITCHER_STATS = ["WHIP", "H", "HR", "ER", "SO", "BB", "HBP", "SOBBratio"]
PITCHER_WEIGHTS = {s: COUNTING for s in PITCHER_STATS}
WEIGHT_GRID = [(i / 10, (10 - i) / 10) for i in range(1, 10)]

# --- fixed values: model features and caps ----------------------------------
HITTER_FEATURES = [
    "SF", "OPS", "K_perc", "BB_perc", "TB", "Contact_perc", "RC_per_PA", "XBH_perc",
    "weighted_spot_avg", "age",
]
HITTER_LABEL = "PA"
PITCHER_LABEL = "batters_faced"
# (value for an infinity, value for a missing one)
RELIEVER_IMPUTE = {"SOBBratio": (21.0, 0.0), "WHIP": (12.0, 0.0)}
