"""Column layouts. Alleles: 0..13, 14 = missing, 15 = end of vector. Words are 32 bits in a BIGINT."""

LONG = "site_id int, hap int, ploidy int, n_allele int, allele int"
SITES = "block_id int, group_id int, archetype string, site_id int, ploidy int, n_allele int, gt binary"
MARKERS = "site_id int, dirty_type int, marker_idx int, ref int, clean int, dirty int, words array<bigint>"
MISSING, EOV, MAX_ALLELE = 14, 15, 13
BLOCK_SITES = 8192
RARE = 10
#: Pairs of length and ploidy in one stream.
MAX_GROUPS = 256
