"""Published holdout forecasts with their metrics and ranks, as expected values."""

# Published predictions of the 28 holdout days by model and category, to four decimals.
PREDICTED = {
    ("ETS", "FOODS"): [
        2938.4483, 2635.7755, 2588.4329, 2580.1989, 2931.3991, 3773.765, 3909.6117, 2938.4483, 2635.7755, 2588.4329,
        2580.1989, 2931.3991, 3773.765, 3909.6117, 2938.4483, 2635.7755, 2588.4329, 2580.1989, 2931.3991, 3773.765,
        3909.6117, 2938.4483, 2635.7755, 2588.4329, 2580.1989, 2931.3991, 3773.765, 3909.6117,
    ],
    ("ETS", "HOBBIES"): [
        501.4337, 481.0608, 477.0198, 477.6732, 544.7453, 641.0607, 577.8083, 501.4838, 481.1072, 477.0629,
        477.7131, 544.7823, 641.095, 577.8401, 501.5133, 481.1346, 477.0883, 477.7366, 544.8041, 641.1153,
        577.8589, 501.5307, 481.1507, 477.1032, 477.7505, 544.817, 641.1272, 577.87,
    ],
    ("ETS", "HOUSEHOLD"): [
        965.3551, 819.2441, 794.2063, 802.4077, 913.6183, 1299.3659, 1316.5371, 965.3551, 819.2441, 794.2063,
        802.4077, 913.6183, 1299.3659, 1316.5371, 965.3551, 819.2441, 794.2063, 802.4077, 913.6183, 1299.3659,
        1316.5371, 965.3551, 819.2441, 794.2063, 802.4077, 913.6183, 1299.3659, 1316.5371,
    ],
    ("XGBoost", "FOODS"): [
        2663.8291, 2426.7915, 2300.2952, 2353.7512, 2810.6326, 3727.6404, 3683.6179, 3137.2292, 2960.8889, 2837.5093,
        2556.3542, 2858.3074, 3887.3408, 3482.2549, 3083.759, 2358.0293, 2590.6455, 2527.1306, 3157.0605, 3529.7205,
        3815.4612, 2720.5051, 2534.2268, 2468.3318, 2552.8582, 2964.6975, 3454.2754, 3781.1707,
    ],
    ("XGBoost", "HOBBIES"): [
        593.6031, 472.2329, 484.1662, 428.3106, 501.711, 579.9243, 641.7501, 500.3332, 535.5733, 524.0865,
        417.7879, 536.3466, 552.5858, 483.3861, 578.4529, 351.9513, 414.3041, 495.9754, 446.144, 653.1064,
        614.9935, 421.8484, 439.1863, 357.7486, 334.2305, 475.9154, 653.6168, 615.9118,
    ],
    ("XGBoost", "HOUSEHOLD"): [
        895.4377, 756.386, 730.0399, 683.4021, 882.9304, 1010.0334, 1171.3279, 1000.0218, 841.6183, 783.5558,
        806.2097, 918.0693, 1325.6469, 990.4785, 921.3083, 733.1627, 706.0433, 739.0546, 886.4762, 1221.1279,
        1079.6814, 856.8842, 725.0819, 735.4308, 768.7972, 850.7606, 1103.3508, 1215.8224,
    ],
}

# Published observations, mae, rmse, wape and bias by category and model.
METRICS = {
    ("FOODS", "ETS"): (28, 242.836, 290.176, 7.486, -5.948),
    ("FOODS", "XGBoost"): (28, 271.739, 339.164, 8.377, -8.377),
    ("FOODS", "Seasonal Naive"): (28, 272.821, 317.321, 8.41, -7.236),
    ("HOBBIES", "XGBoost"): (28, 56.068, 67.19, 10.191, -8.438),
    ("HOBBIES", "ETS"): (28, 69.579, 81.603, 12.647, -3.898),
    ("HOBBIES", "Seasonal Naive"): (28, 75.964, 95.452, 13.807, -3.382),
    ("HOUSEHOLD", "ETS"): (28, 46.76, 72.358, 4.711, -0.544),
    ("HOUSEHOLD", "Seasonal Naive"): (28, 66.857, 86.746, 6.735, -1.274),
    ("HOUSEHOLD", "XGBoost"): (28, 93.701, 119.533, 9.44, -8.836),
    ("ALL", "ETS"): (84, 119.725, 178.976, 7.503, -4.591),
    ("ALL", "Seasonal Naive"): (84, 138.548, 197.761, 8.683, -5.557),
    ("ALL", "XGBoost"): (84, 140.502, 211.215, 8.806, -8.479),
}

# Published ranks by category and model.
RANKS = {
    ("FOODS", "ETS"): 1,
    ("FOODS", "XGBoost"): 2,
    ("FOODS", "Seasonal Naive"): 3,
    ("HOBBIES", "XGBoost"): 1,
    ("HOBBIES", "ETS"): 2,
    ("HOBBIES", "Seasonal Naive"): 3,
    ("HOUSEHOLD", "ETS"): 1,
    ("HOUSEHOLD", "Seasonal Naive"): 2,
    ("HOUSEHOLD", "XGBoost"): 3,
}
