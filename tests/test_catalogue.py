"""Cohorts out of files, and folds."""

from collections import Counter

import pytest

from tilework.operators import cohorts
from tilework.sources import catalogue


def touch(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_cohorts_are_loaded_and_joined(spark, tmp_path):
    for cohort, ids in (("TCGA_COAD", ["TCGA-AA-0001-01", "TCGA-AA-0002-01"]), ("TCGA_READ", ["TCGA-BB-0003-01"])):
        for i in ids:
            touch(tmp_path / cohort / "slides" / "u" / f"{i}.svs")
            touch(tmp_path / cohort / "coords" / f"{i}.svs" / "coords.npy")
        touch(tmp_path / cohort / "features" / f"{ids[0]}.svs" / "features.npy")
        touch(tmp_path / cohort / "hrd.csv", "patient_id,HRD\n" + "".join(f"{i[:12]},0.5\n" for i in ids) + "TCGA-ZZ-9999,1\n")
    known = {c: {k: str(tmp_path / c / k) for k in ("slides", "coords", "features")} | {"HRD": str(tmp_path / c / "hrd.csv")} for c in ("TCGA_COAD", "TCGA_READ")}
    rows = catalogue.load_dataset(spark, "TCGA_CRC", known, "HRD").collect()
    assert sorted((r.slide_id, r.patient_id, r.label, r.features_path is None) for r in rows) == [("TCGA-AA-0001-01", "TCGA-AA-0001", 0.5, False), ("TCGA-AA-0002-01", "TCGA-AA-0002", 0.5, True), ("TCGA-BB-0003-01", "TCGA-BB-0003", 0.5, False)]
    for cohort, label in (("TCGA_LUAD", "HRD"), ("TCGA_COAD", "OS")):
        with pytest.raises(ValueError):
            catalogue.load_dataset(spark, cohort, known, label)


def test_camelyon16_and_nct_crc(spark, tmp_path):
    touch(tmp_path / "labels.csv", ",type,target\nnormal_001,x,Normal\ntumor_001,x,Tumor\ntumor_001,x,Tumor\nlost_001,x,Tumor\n")
    for i in ("normal_001", "tumor_001"):
        touch(tmp_path / "c" / f"{i}.tif" / "coords.npy")
        touch(tmp_path / "s" / f"{i}.tif")
    known = {"CAMELYON16_TRAIN": {"coords": str(tmp_path / "c"), "slides": str(tmp_path / "s"), "labels": str(tmp_path / "labels.csv")}}
    assert sorted((r.slide_id, r.label) for r in catalogue.load_dataset(spark, "CAMELYON16_TRAIN", known).collect()) == [("normal_001", 0.0), ("tumor_001", 1.0)]
    touch(tmp_path / "n" / "ADI" / "a-1.x.tif")
    touch(tmp_path / "n" / "TUM" / "b-2.tif")
    assert sorted((r.image_id, r.label) for r in catalogue.read_nct_crc(spark, str(tmp_path / "n"), {"ADI": 0, "TUM": 8}).collect()) == [("a-1", 0), ("b-2", 8)]
    touch(tmp_path / "meta.csv", ",patient,node,x_coord,y_coord,tumor,center\n0,4,4,3328,21792,1,0\n1,5,1,1,2,0,1\n")
    assert [tuple(r) for r in catalogue.read_camelyon17(spark, str(tmp_path / "meta.csv"), "TRAIN", "p").collect()] == [("patch_patient_004_node_4_x_3328_y_21792", "p/patient_004_node_4/patch_patient_004_node_4_x_3328_y_21792.png", 1, 0)]


def test_subtypes_and_survival(spark, tmp_path):
    touch(tmp_path / "st.tsv", "Patient ID\tSample ID\tTCGA PanCanAtlas Cancer Type Acronym\tSubtype\nP1\tS1\tBRCA\tLumA\nP1\tS2\tBRCA\tLumA\n")
    touch(tmp_path / "clin.csv", "bcr_patient_barcode,gender,OS,OS.time,PFI,PFI.time\nTCGA-AA-1,MALE,1,10,0,20\nTCGA-BB-2,[Not Available],0,5,1,[Not Available]\n")
    assert [tuple(r) for r in catalogue.cohort_labels(spark, "TCGA_BRCA", "MOLECULAR_SUBTYPE", str(tmp_path / "st.tsv")).collect()] == [("P1", "LumA")]
    assert sorted(tuple(r) for r in catalogue.cohort_labels(spark, "TCGA_COAD", "OS", str(tmp_path / "clin.csv")).collect()) == [("TCGA-AA-1", 10.0), ("TCGA-BB-2", -5.0)]
    assert {r.label for r in catalogue.cohort_labels(spark, "TCGA_READ", "CANCER_SUBTYPE", str(tmp_path / "clin.csv")).collect()} == {1.0}


def test_folds_keep_groups_and_labels_together(spark):
    rows = [(i, f"p{i % 37}", i % 37 % 3 == 0, "x") for i in range(500)]
    frame = spark.createDataFrame(rows, "item int, patient_id string, label boolean, center_id string")
    made = cohorts.split_cv(frame, "item", 5, "patient_split", "label")
    assert cohorts.disjoint(made, "patient_id").count() == 0 and made.count() == 500
    patients = {(r.patient_id, r.label, r.fold) for r in made.collect()}
    for label in (True, False):
        n = Counter(f for _, y, f in patients if y == label)
        assert len(n) == 5 and max(n.values()) - min(n.values()) <= 3
    alone = cohorts.split_cv(frame, "item", 5, "center_split", "label")  # one centre: fewer than folds
    assert all(max(c.values()) - min(c.values()) <= 1 for y in (True, False) if (c := Counter(r.fold for r in alone.collect() if r.label == y)))
    with pytest.raises(ValueError):
        cohorts.split_cv(frame, "item", 5, "other")


def test_clinical_columns(spark, tmp_path):
    from tilework.sources import stores

    touch(tmp_path / "clin.csv", "bcr_patient_barcode,gender,ajcc_pathologic_tumor_stage,OS,OS.time,PFI,PFI.time\nTCGA-AA-1,MALE,[Not Available],1,10,0,20\n")
    row = stores.read_clinical(spark, str(tmp_path / "clin.csv")).first()
    assert (row.patient_id, row.center, row.age, row.gender, row.stage, row.grade, row.os, row.pfi) == ("TCGA-AA-1", "AA", None, "MALE", None, None, 10.0, -20.0)
