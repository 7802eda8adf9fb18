"""Dimension lists that come with the engine (S10-S12, D14-D16): gene classes, marker panels and common variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Gene symbols by class.
CLASSES = {
    "hemoglobin": (
        "HBA1 HBA2 HBB HBD HBE1 HBG1 HBG2 HBM HBQ1 HBZ"
    ),
    "apolipoprotein": (
        "APOA1 APOA2 APOA4 APOA5 APOB APOC1 APOC2 APOC3 APOC4 APOD APOE APOF APOH APOL1 "
        "APOL2 APOL3 APOL4 APOL5 APOL6 APOM APOO APOOL"
    ),
    "ribosomal_protein": (
        "RPS2 RPS3 RPS3A RPS4X RPS4Y1 RPS4Y2 RPS5 RPS6 RPS7 RPS8 RPS9 RPS10 RPS11 RPS12 "
        "RPS13 RPS14 RPS15 RPS15A RPS16 RPS17 RPS18 RPS19 RPS20 RPS21 RPS23 RPS24 RPS25 RPS26 "
        "RPS27 RPS27A RPS27L RPS28 RPS29 RPSA RPL3 RPL3L RPL4 RPL5 RPL6 RPL7 RPL7A RPL7L1 "
        "RPL8 RPL9 RPL10 RPL10A RPL10L RPL11 RPL12 RPL13 RPL13A RPL14 RPL15 RPL17 RPL18 RPL18A "
        "RPL19 RPL21 RPL22 RPL22L1 RPL23 RPL23A RPL24 RPL26 RPL26L1 RPL27 RPL27A RPL28 RPL29 RPL30 "
        "RPL31 RPL32 RPL34 RPL35 RPL35A RPL36 RPL36A RPL36AL RPL37 RPL37A RPL38 RPL39 RPL39L RPL41 "
        "RPLP0 RPLP1 RPLP2 MRPS2 MRPS5 MRPS6 MRPS7 MRPS9 MRPS10 MRPS11 MRPS12 MRPS14 MRPS15 MRPS16 "
        "MRPS17 MRPS18A MRPS18B MRPS18C MRPS21 MRPS22 MRPS23 MRPS24 MRPS25 MRPS26 MRPS27 MRPS28 MRPS30 MRPS31 "
        "MRPS33 MRPS34 MRPS35 MRPS36 MRPL1 MRPL2 MRPL3 MRPL4 MRPL9 MRPL10 MRPL11 MRPL12 MRPL13 MRPL14 "
        "MRPL15 MRPL16 MRPL17 MRPL18 MRPL19 MRPL20 MRPL21 MRPL22 MRPL23 MRPL24 MRPL27 MRPL28 MRPL30 MRPL32 "
        "MRPL33 MRPL34 MRPL35 MRPL36 MRPL37 MRPL38 MRPL39 MRPL40 MRPL41 MRPL42 MRPL43 MRPL44 MRPL45 MRPL46 "
        "MRPL47 MRPL48 MRPL49 MRPL50 MRPL51 MRPL52 MRPL53 MRPL54 MRPL55 MRPL57 MRPL58"
    ),
}
# Marker genes by panel and cell type.
PANELS = {
    "lm22": {
        "T_cells": "CD3D CD3E CD3G", "T_cells_CD4": "CD4", "T_cells_CD8": "CD8A CD8B", "B_cells": "CD19 MS4A1 CD79A CD79B",
        "NK_cells": "NCAM1 NKG7 KLRD1 GNLY", "Monocytes": "CD14 LYZ S100A8 S100A9", "Macrophages": "CD68 MARCO MRC1 CSF1R", "Dendritic_cells": "FCER1A CLEC10A IRF8",
        "Neutrophils": "ELANE MPO FCGR3B CSF3R", "T_cells_regulatory": "FOXP3 IL2RA", "Mast_cells": "TPSAB1 CPA3",
    },
    "tabula_sapiens_cfrna": {
        "Hepatocyte": "ALB APOB APOA1 TTR CYP3A4 HNF4A", "Kidney_tubular": "UMOD SLC12A3", "Kidney_podocyte": "NPHS1 NPHS2", "Lung_alveolar_AT2": "SFTPC SFTPB",
        "Lung_club_cell": "SCGB1A1", "Lung_ciliated": "FOXJ1", "Intestinal_goblet": "MUC2", "Intestinal_enterocyte": "VIL1",
        "Intestinal_stem": "LGR5", "Cardiomyocyte": "TNNT2 MYH7 NKX2-5", "Pancreatic_beta": "INS", "Pancreatic_alpha": "GCG",
        "Pancreatic_endocrine": "NEUROD1", "Astrocyte": "GFAP", "Oligodendrocyte": "MBP", "Neuron": "MAP2",
    },
    "vorperian": {
        "Hepatocyte": "ALB HP", "Erythroblast": "HBB HBA1 GYPA", "Megakaryocyte_platelet": "ITGA2B PF4 GP1BA", "Syncytiotrophoblast": "CGA CGB1 CYP19A1",
        "Astrocyte": "GFAP", "Oligodendrocyte": "MBP", "Neuron": "SYP RBFOX3", "Pancreatic_beta": "INS",
        "Kidney_tubular": "UMOD", "Kidney_podocyte": "NPHS1", "Lung_alveolar_AT2": "SFTPC", "Cardiomyocyte": "TNNT2 MYH7",
        "Kidney_TAL": "SLC12A1", "Kidney_collecting_duct": "AQP2",
    },
}
# Contig, place (from 1), reference, alternative and name of common variants of GRCh38.
SNPS = """
chr1 159204893 A G rs1426654
chr1 220943497 G A rs2814778
chr2 136608646 C T rs4988235
chr3 49395673 T C rs2241766
chr5 1280028 C T rs10936599
chr7 28172586 T C rs2237892
chr10 112570808 G T rs7903146
chr12 121163769 C T rs7895833
chr15 28197037 C T rs1426654
chr16 53767042 A C rs9939609
chr17 7676040 G A rs1042522
chr19 44908684 T C rs7412
"""


def classes(spark: SparkSession) -> DataFrame:
    """class and symbol."""
    return spark.createDataFrame([(name, s) for name, text in CLASSES.items() for s in text.split()], "class string, symbol string")


def panels(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The named panels, or all: gene_id (none), gene_symbol, panel, cell_type."""
    unknown = set(names or ()) - set(PANELS)
    if unknown:
        raise ValueError(f"unknown panels: {sorted(unknown)}; there are {sorted(PANELS)}")
    rows = [(None, g, p, cell) for p in (names if names is not None else PANELS) for cell, text in PANELS[p].items() for g in text.split()]
    return spark.createDataFrame(rows, "gene_id string, gene_symbol string, panel string, cell_type string")


def snps(spark: SparkSession, contigs: DataFrame | None = None) -> DataFrame:
    """contig, site (from 0), ref, alt and rsid; with contigs (tid, name) those of known contigs, with tid."""
    rows = [(c, int(at) - 1, ref, alt, name) for c, at, ref, alt, name in map(str.split, SNPS.strip().splitlines())]
    sites = spark.createDataFrame(rows, "contig string, site long, ref string, alt string, rsid string")
    return sites if contigs is None else sites.join(F.broadcast(contigs.select("tid", F.col("name").alias("contig"))), "contig")  # a row for each contig
