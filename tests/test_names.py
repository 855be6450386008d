"""Classes of names, corners of faces and byte widths against values written out by hand."""

from lattica.functions.names import classified
from lattica.operators import mesh

SHAPES = {
    "slab": "oak_slab stone_slab cut_red_sandstone_slab bamboo_mosaic_slab",
    "stair": "oak_stairs brick_stairs waxed_cut_copper_stairs",
    "fence": "oak_fence nether_brick_fence",
    "fence_gate": "oak_fence_gate crimson_fence_gate",
    "wall": "cobblestone_wall mud_brick_wall",
    "pane": "glass_pane red_stained_glass_pane iron_bars",
    "door": "iron_door oak_door",
    "trapdoor": "iron_trapdoor oak_trapdoor",
    "wall_torch": "redstone_wall_torch soul_wall_torch",
    "torch": "redstone_torch soul_torch",
    "carpet": "white_carpet moss_carpet",
    "pressure_plate": "stone_pressure_plate light_weighted_pressure_plate",
    "button": "stone_button oak_button",
    "ladder": "ladder",
    "bed": "red_bed",
    "wall_sign": "oak_wall_sign warped_wall_sign",
    "sign": "oak_sign oak_hanging_sign",
    "rail": "rail powered_rail detector_rail activator_rail",
    "layer": "snow lily_pad",
    "inset_cube": "cactus",
    "chain": "chain",
    "cross": "cobweb oak_sapling short_grass poppy vine wheat bamboo azalea leaf_litter kelp_plant nether_wart sunflower",
    "cube": "stone torch wall_banner oak_leaves snow_block tree_marker building_marker foliage_marker bamboo_block white_wool big_dripleaf_stem potted_poppy chain_command_block iron_barsx fern_block",
}
COLORS = {
    "#7f00cc": "tree_marker", "#ff0000": "foliage_marker", "#3399ff": "building_marker", "#7a6243": "grass_block", "#6b5b6e": "mycelium", "#5a4226": "podzol", "#9c8158": "dirt_path grass_path",
    "#e9ecec": "white_wool white_carpet white_stained_glass white_concrete_powder", "#3cabd6": "light_blue_bed light_blue_glazed_terracotta", "#8e8e86": "light_gray_banner", "#a02722": "red_terracotta red_shulker_box", "#191616": "black_candle",
    "#985f49": "terracotta", "#9c7a4a": "oak_planks oak_log oak_leaves", "#412c1d": "dark_oak_door", "#cfc6a8": "pale_oak_wood", "#b9b94a": "bamboo bamboo_mosaic", "#287f78": "warped_stem warped_nylium",
    "#8c8c8c": "stone stone_slab stone_brick_stairs", "#888888": "stone_bricks", "#7a7a7a": "cobblestone cobblestone_wall", "#74815f": "mossy_cobblestone mossy_cobblestone_wall", "#454649": "deepslate deepslate_tiles deepslate_iron_ore", "#9a5236": "bricks", "#5fa399": "prismarine prismarine_bricks_x", "#2b2429": "blackstone blackstone_wall",
    "#363636": "coal_ore", "#79e6e0": "diamond_ore", "#c98a3e": "nether_gold_ore", "#dcb73a": "raw_gold_block", "#2a5fb0": "water", "#d8540f": "lava", "#9bc8ee": "packed_ice",
    "#4f7a2c": "azalea_leaves flowering_azalea_leaves", "#3f7d33": "other_leaves", "#5d9c3a": "short_grass large_fern", "#7a5a32": "dead_bush", "#dccd8c": "sand sandstone smooth_sandstone_slab chiseled_sandstone", "#a85a2e": "red_sand red_sandstone cut_red_sandstone_slab",
    "#6e4a2c": "dirt coarse_dirt farmland packed_mud", "#9aa1ad": "clay", "#f3f6f8": "snow powder_snow", "#9a6fd6": "amethyst_block small_amethyst_bud amethyst_cluster", "#bfe6f0": "glass glass_pane", "#ece6da": "quartz_block quartz_stairs", "#a8a8a8": "iron_block wool red_nether_bricks suspicious_sand",
}
TOPS = {"#5d8a3c": "grass_block", "#8a7a8e": "mycelium", "#5d4a2e": "podzol", "#8a9a55": "dirt_path grass_path", None: "dirt stone farmland"}
CATEGORIES = {
    "tree_marker": "tree_marker", "foliage_marker": "foliage_marker", "building": "building_marker", "leaf": "oak_leaves azalea_leaves", "wood": "oak_log stripped_oak_log oak_wood crimson_stem warped_stem crimson_hyphae",
    "stumpable": "dirt grass_block podzol gravel warped_nylium", "other": "stone oak_planks stem mushroom_stem sand red_sand snow_block dirt_path soul_sand",
}
MATERIALS = {
    ("log", 0): "oak_log", ("log", 5): "dark_oak_log", ("log", 8): "pale_oak_log", ("log", 9): "crimson_stem", ("log", 10): "warped_stem", ("log", -1): "stripped_oak_log", ("wood", 1): "spruce_wood", ("wood", 9): "crimson_hyphae",
    ("leaf", 2): "birch_leaves", ("leaf", 3): "jungle_leaves", ("leaf", 4): "acacia_leaves", ("leaf", 6): "mangrove_leaves", ("leaf", 7): "cherry_leaves", ("leaf", -1): "azalea_leaves", (None, -1): "oak_planks oak_sapling stone pumpkin_stem stripped_crimson_stem",
}
STUMPABLE = {True: "dirt mud clay sand red_sand soul_sand snow_block farmland rooted_dirt crimson_nylium", False: "stone oak_log soul_soil snow sandstone packed_mud"}
NATURAL = {
    True: "air water stone dirt iron_ore deepslate_gold_ore oak_sapling tube_coral brain_coral_block fire_coral_fan horn_coral_wall_fan azalea_leaves flowering_azalea_leaves obsidian cactus pumpkin wheat tree_marker bee_nest glowstone mushroom_stem snow basalt",
    False: "oak_log oak_leaves crimson_stem oak_wood warped_hyphae oak_planks glass building_marker cobblestone sandstone terracotta torch chest polished_basalt melon hay_block beehive",
}
DISCARDABLE = {True: "sandstone red_sandstone cut_sandstone chiseled_red_sandstone smooth_sandstone terracotta red_terracotta light_blue_terracotta", False: "white_glazed_terracotta sand sandstone_slab cut_copper stone"}


def test_labels(spark):
    tables = {"shape": SHAPES, "color": COLORS, "top_color": TOPS, "category": CATEGORIES, "is_stumpable": STUMPABLE, "is_natural": NATURAL, "is_discardable": DISCARDABLE}
    want = {(column, name): label for column, labels in tables.items() for label, names in labels.items() for name in names.split()}
    want |= {(c, name): label[k] for label, names in MATERIALS.items() for name in names.split() for k, c in enumerate(("material", "variety"))}
    names = sorted({n for _, n in want})
    assert len(names) > 150
    found = {r.name: r for r in classified(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")).collect()}
    assert {key: found[key[1]][key[0]] for key in want} == want
    assert set(found[None]) == {None}


def test_corners():
    """Each face's corners lie on its side of the block and go once around it; they are those of the renderer's drawing."""
    assert mesh.CORNERS[0, 0, -1] == ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)) and mesh.CORNERS[1, 0, 0] == ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))
    assert len(mesh.CORNERS) == 6
    for normal, corners in mesh.CORNERS.items():
        (axis,) = [k for k in range(3) if normal[k]]
        assert {c[axis] for c in corners} == {max(normal[axis], 0)} and len(set(corners)) == 4 and corners[0] == min(corners)
        for a, b in zip(corners, (*corners[1:], corners[0])):
            assert sum(abs(p - q) for p, q in zip(a, b)) == 1


def test_byte_widths(spark):
    from lattica.functions import codec

    cases = [((0, 0, 0, 0, 0), (1, 1, 1, 1)), ((255, 3, 127, -127, 127), (1, 1, 1, 1)), ((256, 0, 128, 1, -128), (2, 2, 1, 2)), ((1, 65_535, -32_767, 32_768, 0), (2, 2, 3, 1)), ((65_536, 1, 8_388_607, 8_388_608, 5), (3, 3, 4, 1))]
    for row, (code, x, y, z) in cases:
        df = spark.createDataFrame([row, (0, 0, 0, 0, 0)], "id int, prop int, x int, y int, z int")
        assert codec.inferred_widths(df) == {"code": code, "x": x, "y": y, "z": z}, row
