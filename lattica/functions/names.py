"""What a block's name says about it, as SQL CASE rules over a dictionary of names.

Everything here depends on the name alone. Blocks are classified row by row, in the stage that reads them (see classified);
block_classes gives the dimension, a row per distinct name. Rules are tried in order; the first that holds gives the label. The SQL runs alike in Spark and other engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """label, if name is one of names, ends or starts in one of those, and has none of the exceptions."""

    label: str | None
    names: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    without: tuple[str, ...] = ()  # endings
    inside: tuple[str, ...] = ()  # strings that may not occur
    never: tuple[str, ...] = ()  # names

    def sql(self, name: str) -> str:
        some = []
        if self.names:
            some.append(f"{name} IN ({', '.join(map(_quoted, self.names))})")
        some += [f"right({name}, {len(e)}) = {_quoted(e)}" for e in self.ends]
        some += [f"left({name}, {len(s)}) = {_quoted(s)}" for s in self.starts]
        out = "(" + " OR ".join(some) + ")"
        out += "".join(f" AND right({name}, {len(e)}) <> {_quoted(e)}" for e in self.without)
        out += "".join(f" AND replace({name}, {_quoted(s)}, '') = {name}" for s in self.inside)
        return out + "".join(f" AND {name} <> {_quoted(n)}" for n in self.never)


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def case(rules: tuple[Rule, ...], default: str | None, name: str = "name") -> str:
    return "CASE " + " ".join(f"WHEN {r.sql(name)} THEN {_quoted(r.label)}" for r in rules) + f" ELSE {_quoted(default)} END"


# Names, endings and colours that results depend on.
VARIETIES = ("oak", "spruce", "birch", "jungle", "acacia", "dark_oak", "mangrove", "cherry", "pale_oak", "crimson", "warped")
LOG = Rule("log", names=("crimson_stem", "warped_stem"), ends=("_log",))
WOOD = Rule("wood", ends=("_wood", "_hyphae"))
LEAF = Rule("leaf", ends=("_leaves",))
STUMPABLE_NAMES = (
    "dirt", "grass_block", "coarse_dirt", "podzol", "rooted_dirt", "moss_block", "pale_moss_block", "mud", "muddy_mangrove_roots",
    "mycelium", "farmland", "clay", "crimson_nylium", "warped_nylium", "gravel", "sand", "red_sand", "dirt_path", "grass_path", "soul_sand", "snow_block",
)
#: The renderer's list is shorter.
RENDER_STUMPABLE_NAMES = STUMPABLE_NAMES[:15]
NATURAL_NAMES = (
    "air", "cave_air", "void_air", "water", "lava", "bubble_column", "tree_marker", "foliage_marker",
    "grass_block", "dirt", "coarse_dirt", "podzol", "rooted_dirt", "mycelium", "mud", "muddy_mangrove_roots", "farmland",
    "mangrove_roots", "moss_block", "pale_moss_block", "moss_carpet", "pale_moss_carpet",
    "sand", "red_sand", "gravel", "clay", "suspicious_sand", "suspicious_gravel",
    "stone", "granite", "diorite", "andesite", "deepslate", "tuff", "calcite", "dripstone_block", "pointed_dripstone", "bedrock", "obsidian", "crying_obsidian", "smooth_basalt", "magma_block",
    "raw_iron_block", "raw_copper_block",
    "amethyst_block", "budding_amethyst", "amethyst_cluster", "small_amethyst_bud", "medium_amethyst_bud", "large_amethyst_bud",
    "ancient_debris", "netherrack", "soul_sand", "soul_soil", "glowstone", "basalt", "blackstone", "gilded_blackstone", "crimson_nylium", "warped_nylium", "shroomlight", "nether_wart_block", "warped_wart_block", "bone_block",
    "end_stone", "chorus_flower", "chorus_plant", "snow", "snow_block", "powder_snow", "ice", "packed_ice", "blue_ice", "frosted_ice",
    "cobweb", "turtle_egg", "frogspawn", "sea_pickle", "bee_nest", "pumpkin", "sculk", "sculk_vein", "sculk_sensor", "sculk_catalyst", "sculk_shrieker",
    "short_grass", "grass", "tall_grass", "fern", "large_fern", "dead_bush", "bush", "firefly_bush", "leaf_litter", "short_dry_grass", "tall_dry_grass", "wildflowers",
    "vine", "weeping_vines", "weeping_vines_plant", "twisting_vines", "twisting_vines_plant", "cave_vines", "cave_vines_plant", "glow_lichen", "hanging_roots", "spore_blossom", "big_dripleaf", "big_dripleaf_stem", "small_dripleaf", "pink_petals",
    "kelp", "kelp_plant", "seagrass", "tall_seagrass", "lily_pad", "bamboo", "bamboo_sapling", "sugar_cane", "cactus", "nether_wart", "sweet_berry_bush", "azalea", "flowering_azalea",
    "wheat", "carrots", "potatoes", "beetroots", "pumpkin_stem", "melon_stem", "attached_pumpkin_stem", "attached_melon_stem", "torchflower_crop", "cocoa", "fire", "soul_fire",
    "crimson_roots", "warped_roots", "nether_sprouts", "crimson_fungus", "warped_fungus", "brown_mushroom", "red_mushroom", "brown_mushroom_block", "red_mushroom_block", "mushroom_stem",
    "dandelion", "poppy", "blue_orchid", "allium", "azure_bluet", "red_tulip", "orange_tulip", "white_tulip", "pink_tulip", "oxeye_daisy", "cornflower", "lily_of_the_valley", "wither_rose",
    "torchflower", "sunflower", "lilac", "rose_bush", "peony", "pitcher_plant", "pitcher_crop", "closed_eyeblossom", "open_eyeblossom",
)
SANDSTONE_NAMES = ("sandstone", "red_sandstone", "smooth_sandstone", "smooth_red_sandstone", "cut_sandstone", "cut_red_sandstone", "chiseled_sandstone", "chiseled_red_sandstone")
CROSS_NAMES = (
    "short_grass", "grass", "tall_grass", "fern", "large_fern", "dead_bush", "dandelion", "poppy", "blue_orchid", "allium", "azure_bluet", "red_tulip",
    "orange_tulip", "white_tulip", "pink_tulip", "oxeye_daisy", "cornflower", "lily_of_the_valley", "wither_rose", "torchflower", "sunflower", "lilac",
    "rose_bush", "peony", "pitcher_plant", "sweet_berry_bush", "nether_wart", "crimson_roots", "warped_roots", "nether_sprouts", "twisting_vines",
    "twisting_vines_plant", "weeping_vines", "weeping_vines_plant", "cave_vines", "cave_vines_plant", "vine", "glow_lichen", "hanging_roots",
    "spore_blossom", "big_dripleaf", "small_dripleaf", "pink_petals", "kelp", "kelp_plant", "seagrass", "tall_seagrass", "wheat", "carrots",
    "potatoes", "beetroots", "bamboo", "sugar_cane", "azalea", "flowering_azalea", "bush", "firefly_bush", "leaf_litter",
)
DYES = {
    "white": "#e9ecec", "orange": "#f07613", "magenta": "#bf4ba7", "light_blue": "#3cabd6", "yellow": "#f6c01b", "lime": "#70b819", "pink": "#ed8dac", "gray": "#3e4447",
    "light_gray": "#8e8e86", "cyan": "#158992", "purple": "#792aac", "blue": "#35399c", "brown": "#664c33", "green": "#546c1d", "red": "#a02722", "black": "#191616",
}
DYED = ("_wool", "_carpet", "_concrete", "_concrete_powder", "_stained_glass", "_stained_glass_pane", "_terracotta", "_glazed_terracotta", "_candle", "_bed", "_banner", "_shulker_box")
WOODS = {
    "oak": "#9c7a4a", "spruce": "#5b3a23", "birch": "#d8c98f", "jungle": "#9c6b4a", "acacia": "#bb5b32", "dark_oak": "#412c1d", "mangrove": "#6f3326", "cherry": "#e3b7c0",
    "pale_oak": "#cfc6a8", "bamboo": "#b9b94a", "crimson": "#7c324a", "warped": "#287f78",
}
STONES = {
    "stone": "#8c8c8c", "cobblestone": "#7a7a7a", "mossy_cobblestone": "#74815f", "stone_bricks": "#888888", "mossy_stone_bricks": "#7e8a6e", "cracked_stone_bricks": "#7f7f7f",
    "granite": "#946a5a", "diorite": "#bdbdbd", "andesite": "#888a8c", "deepslate": "#454649", "deepslate_bricks": "#3f4043", "tuff": "#6b6c5f",
    "calcite": "#dde0d8", "blackstone": "#2b2429", "basalt": "#54514f", "smooth_basalt": "#535355", "bricks": "#9a5236", "obsidian": "#15101c",
    "crying_obsidian": "#2a0e3c", "bedrock": "#5a5a5a", "gravel": "#8b8378", "quartz_block": "#ece6da", "purpur_block": "#a276a8", "end_stone": "#dcdca7",
    "netherrack": "#6b3a3a", "nether_bricks": "#2c1818", "soul_sand": "#52402f", "soul_soil": "#4a382a", "crimson_nylium": "#7a1f1f", "warped_nylium": "#147c6f",
    "prismarine": "#5fa399", "prismarine_bricks": "#63ada0", "dark_prismarine": "#345e4e",
}
ORES = {
    "coal_ore": "#363636", "iron_ore": "#af9a86", "copper_ore": "#9a5a3c", "gold_ore": "#dec33d", "redstone_ore": "#8c2020", "lapis_ore": "#2742a8", "diamond_ore": "#79e6e0", "emerald_ore": "#1fae5c",
    "deepslate_coal_ore": "#39393b", "deepslate_iron_ore": "#9a8978", "deepslate_copper_ore": "#8a5640", "deepslate_gold_ore": "#c2ab40",
    "deepslate_redstone_ore": "#7e2626", "deepslate_lapis_ore": "#33458e", "deepslate_diamond_ore": "#6bbdb8", "deepslate_emerald_ore": "#2c8f57",
    "nether_gold_ore": "#c98a3e", "nether_quartz_ore": "#a6776a", "ancient_debris": "#5a4438", "raw_iron_block": "#c2a384", "raw_copper_block": "#a8643f", "raw_gold_block": "#dcb73a",
}
LIQUIDS = {"water": "#2a5fb0", "lava": "#d8540f"}
ICES = {"ice": "#7fb6e8", "packed_ice": "#9bc8ee", "blue_ice": "#74c3e6", "frosted_ice": "#a9d4ee"}
MARKERS = {"tree_marker": "#7f00cc", "foliage_marker": "#ff0000", "building_marker": "#3399ff"}
TOPS = {"grass_block": "#5d8a3c", "mycelium": "#8a7a8e", "podzol": "#5d4a2e", "dirt_path": "#8a9a55", "grass_path": "#8a9a55"}
RELEVANT_PROPERTIES = ("facing", "half", "type", "shape", "hinge", "open", "axis", "north", "south", "east", "west", "rotation", "part", "powered")
# End of fixed values.

MATERIAL = case((LOG, WOOD, LEAF), None)
VARIETY = "CAST(" + case(tuple(Rule(str(k), starts=(v,)) for k, v in enumerate(VARIETIES)), "-1") + " AS INT)"
STUMPABLE = Rule("y", names=STUMPABLE_NAMES).sql("name")
NATURAL = (
    case(
        (
            Rule("y", names=("azalea_leaves", "flowering_azalea_leaves")),
            Rule("n", names=LOG.names, ends=("_log", "_wood", "_hyphae", "_leaves")),
            Rule("y", ends=("_ore", "_sapling", "_coral", "_coral_block", "_coral_fan", "_coral_wall_fan")),
            Rule("y", names=NATURAL_NAMES),
        ),
        "n",
    )
    + " = 'y'"
)
DISCARDABLE = case((Rule("y", names=(*SANDSTONE_NAMES, "terracotta")), Rule("y", ends=("_terracotta",), without=("_glazed_terracotta",))), "n") + " = 'y'"
CATEGORY = case(
    (
        Rule("tree_marker", names=("tree_marker",)),
        Rule("foliage_marker", names=("foliage_marker",)),
        Rule("building", names=("building_marker",)),
        Rule("leaf", ends=LEAF.ends),
        Rule("wood", names=LOG.names, ends=(*LOG.ends, *WOOD.ends)),
        Rule("stumpable", names=RENDER_STUMPABLE_NAMES),
    ),
    "other",
)
SHAPE = case(
    (
        Rule("cube", names=tuple(MARKERS)),
        Rule("slab", ends=("_slab",)),
        Rule("stair", ends=("_stairs",)),
        Rule("fence", ends=("_fence",)),
        Rule("fence_gate", ends=("_fence_gate",)),
        Rule("wall", ends=("_wall",), inside=("torch",)),
        Rule("pane", names=("glass_pane", "iron_bars"), ends=("_glass_pane",)),
        Rule("door", ends=("_door",)),
        Rule("trapdoor", ends=("_trapdoor",)),
        Rule("wall_torch", ends=("_wall_torch",)),
        Rule("torch", ends=("_torch",)),
        Rule("carpet", ends=("_carpet",)),
        Rule("pressure_plate", ends=("_pressure_plate",)),
        Rule("button", ends=("_button",)),
        Rule("ladder", names=("ladder",)),
        Rule("bed", ends=("_bed",)),
        Rule("wall_sign", ends=("_wall_sign",)),
        Rule("sign", ends=("_sign",)),
        Rule("rail", names=("rail", "powered_rail", "detector_rail", "activator_rail")),
        Rule("layer", names=("lily_pad",), starts=("snow",), never=("snow_block",)),
        Rule("inset_cube", names=("cactus",)),
        Rule("chain", names=("chain",)),
        Rule("cross", names=("cobweb", *CROSS_NAMES), ends=("_sapling",)),
    ),
    "cube",
)


def _each(table: dict[str, str]) -> tuple[Rule, ...]:
    return tuple(Rule(color, names=(name,)) for name, color in table.items())


def _stem(*stems: str) -> tuple[str, ...]:
    return tuple(f"{cut}{s}" for s in stems for cut in ("", "smooth_", "cut_", "chiseled_"))


_DYE = case(tuple(Rule(color, names=(dye,), starts=(f"{dye}_",)) for dye, color in DYES.items()), None)
_OTHER_COLOR = case(
    (
        Rule("#985f49", names=("terracotta",)),
        *(Rule(color, starts=(wood,)) for wood, color in WOODS.items()),
        *_each(STONES),
        *(Rule(color, starts=(stem,)) for stem, color in STONES.items()),
        *_each(ORES | LIQUIDS | ICES),
        Rule("#4f7a2c", ends=("azalea_leaves",)),
        Rule("#3f7d33", ends=LEAF.ends),
        Rule("#5d9c3a", names=("short_grass", "grass", "tall_grass", "fern", "large_fern")),
        Rule("#7a5a32", names=("dead_bush",)),
        Rule("#dccd8c", names=("sand",), starts=_stem("sandstone")),
        Rule("#a85a2e", names=("red_sand",), starts=_stem("red_sandstone")),
        Rule("#6e4a2c", names=("dirt", "coarse_dirt", "rooted_dirt", "farmland", "mud", "packed_mud", "muddy_mangrove_roots")),
        Rule("#9aa1ad", names=("clay",)),
        Rule("#f3f6f8", names=("snow", "snow_block", "powder_snow")),
        Rule("#9a6fd6", starts=("amethyst",), ends=("amethyst_bud", "amethyst_cluster")),
        Rule("#bfe6f0", starts=("glass",)),
        Rule("#ece6da", starts=("quartz",)),
    ),
    "#a8a8a8",
)
_FIRST_COLOR = case((*_each(MARKERS), Rule("#7a6243", names=("grass_block",)), Rule("#6b5b6e", names=("mycelium",)), Rule("#5a4226", names=("podzol",)), Rule("#9c8158", names=("dirt_path", "grass_path"))), None)
COLOR = f"coalesce({_FIRST_COLOR}, CASE WHEN {Rule('', ends=DYED).sql('name')} THEN {_DYE} END, {_OTHER_COLOR})"
TOP_COLOR = case(_each(TOPS), None)

#: Columns of the dimension, as SQL over a column name.
CLASSES = {
    "material": MATERIAL,
    "variety": f"CASE WHEN {MATERIAL} IS NULL THEN -1 ELSE {VARIETY} END",
    "is_stumpable": STUMPABLE,
    "is_natural": NATURAL,
    "is_discardable": DISCARDABLE,
    "category": CATEGORY,
    "shape": SHAPE,
    "color": COLOR,
    "top_color": TOP_COLOR,
}


def block_classes(names: DataFrame, *columns: str) -> DataFrame:
    """A row per distinct name with the given classes (all by default)."""
    return names.select("name").where("name is not null").distinct().select("name", *[F.expr(CLASSES[c]).alias(c) for c in columns or CLASSES])


def classified(blocks: DataFrame, *columns: str) -> DataFrame:
    """blocks with classes of their names (all by default), worked out row by row: no pass over the names, and no join."""
    return blocks.select("*", *[F.when(F.col("name").isNotNull(), F.expr(CLASSES[c])).alias(c) for c in columns or CLASSES])
