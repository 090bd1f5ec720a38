"""Fixed values for the checking SQL, written out apart from those the queries use."""

NOT_PLATE_APPEARANCE = """('caught_stealing_3b', 'caught_stealing_2b', 'pickoff_caught_stealing_2b', 'pickoff_2b',
  'pickoff_caught_stealing_3b', 'pickoff_1b', 'wild_pitch', 'game_advisory', 'caught_stealing_home', 'pickoff_3b',
  'stolen_base_2b', 'stolen_base_3b', 'passed_ball', 'pickoff_caught_stealing_home', 'pickoff_error_3b')"""
HITS = "('single', 'double', 'triple', 'home_run')"
HITS_AND_WALKS = "('walk', 'single', 'double', 'triple', 'home_run')"
AT_BATS = """('single', 'double', 'triple', 'home_run', 'field_out', 'strikeout', 'field_error', 'force_out',
  'grounded_into_double_play', 'fielders_choice', 'other_out', 'strikeout_double_play', 'fielders_choice_out',
  'double_play', 'sac_fly_double_play', 'triple_play', 'sac_bunt_double_play')"""
PITCHER_STRIKEOUTS = "('strikeout', 'strikeout_double_play')"
SINGLE_OUTS = """('caught_stealing_home', 'pickoff_3b', 'pickoff_1b', 'pickoff_caught_stealing_3b',
  'pickoff_caught_stealing_2b', 'fielders_choice_out', 'other_out', 'sac_bunt', 'sac_fly', 'force_out',
  'caught_stealing_3b', 'strikeout')"""
DOUBLE_OUTS = "('grounded_into_double_play', 'strikeout_double_play', 'double_play', 'sac_bunt_double_play')"
PITCHER_STATS = ["WHIP", "H", "HR", "ER", "SO", "BB", "HBP", "SOBBratio"]
COUNTING = ((0.2, 0.3, 0.5), (0.4, 0.6))
CONTACT = ((0.15, 0.25, 0.6), (0.3, 0.7))
POWER = ((0.1, 0.2, 0.7), (0.2, 0.8))
HITTER_WEIGHTS = {
    "TB": COUNTING, "weighted_spot_avg": COUNTING, "K_perc": CONTACT, "Contact_perc": CONTACT, "RC_per_PA": CONTACT,
    "SF": POWER, "OPS": POWER, "BB_perc": POWER, "XBH_perc": POWER,
}
